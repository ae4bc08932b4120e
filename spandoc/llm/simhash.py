"""Near copies: SimHash fingerprints linked through multi-index hashing.

``near_copies`` links by fingerprints alone.  ``similar_copies`` looks further, up to a similarity of the texts'
shingle sets: fingerprints of such texts may differ in ten bits and more, so texts are found by their rarest
shingles instead, which misses none, and the sets themselves decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from spandoc.llm.common import Space, heavy_join, sized
from spandoc.llm.graph import components

BITS = 64
# Buckets above this many fingerprints are clustered in one task each instead of joined pair by pair ...
DENSE = 64
# ... groups above this many are dealt over smaller ones, those above CUT times as many by bits outside their segment.
SPLIT = 20_000
CUT = 8
# The index of a group of ``similar_copies`` is made anew when it has this many times the texts that are left.
FEW = 8
# Shingles of a group of ``similar_copies`` that meet in one task; a group with more, or with more than
# 1/HOT of all, is dealt over parts, PARTS at least.
SHARE = 2_000_000
HOT, PARTS = 50, 24


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: only A-Z, only ASCII blanks


def _shingles(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words (fewer words: of all of them), repeats included."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    n = max(1, len(words) - width + 1)
    pairs = zip(start[:n].tolist(), end[min(width, len(words)) - 1:].tolist())
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in pairs), np.uint64, n)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        block = hashes[i:i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash over the ``width``-word shingles of ``text``, as a signed 64-bit integer."""
    return _majority(_shingles(_words(text), width))


def fingerprints(entities: DataFrame, width: int = 4) -> DataFrame:
    """(entity_id, fingerprint) of every row; a text without words has fingerprint zero."""
    rows = entities.select("entity_id", "text")
    schema = T.StructType([rows.schema["entity_id"], T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint(x.as_py(), width) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], ["entity_id", "fingerprint"])

    return rows.mapInArrow(run, schema)


def _segments(parts: int, distance: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) per segment: within ``distance`` bits, some segment differs by at most its radius."""
    if distance + 1 > 2 * parts:
        raise ValueError("take more segments: radii above one are not enumerated")
    widths = [BITS // parts + (i < BITS % parts) for i in range(parts)]
    shifts = [sum(widths[:i]) for i in range(parts)]
    return [(s, w, int(i < distance + 1 - parts)) for i, (s, w) in enumerate(zip(shifts, widths))]


def _field(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _ball(seg: int, key: Column, flips: int) -> Column:
    """Array of (seg, key, own): the key itself and, for each zero among its ``flips`` bits, the key with that bit set."""
    bits = F.array(*[F.lit(x).cast("bigint") for x in (0, *(1 << i for i in range(flips)))])
    free = F.filter(bits, lambda x: key.bitwiseAND(x) == 0)
    return F.transform(free, lambda x: F.struct(F.lit(seg).alias("seg"), key.bitwiseOR(x).alias("key"), (x == 0).alias("own")))


def _cluster(fps: np.ndarray, distance: int) -> np.ndarray:
    """The smallest fingerprint each of ``fps`` (distinct, sorted) is linked with by chains inside the array."""
    root = fps.copy()
    left = np.arange(len(fps))
    while len(left):
        queue, top = [left[0]], fps[left[0]]
        left = left[1:]
        while queue and len(left):
            near = np.bitwise_count((fps[left] ^ fps[queue.pop()]).view(np.uint64)) <= distance
            hit = left[near]
            if len(hit):
                left = left[~near]
                root[hit] = top
                queue.extend(hit.tolist())
    return root


def _members(lookups: DataFrame, counts: DataFrame, space: Space) -> DataFrame:
    """(seg, key, fp) of all that look into the buckets of ``counts``; crowded buckets are broadcast, being no more than rows / SPLIT."""
    crowded = space.write(counts.filter(F.col("n") > SPLIT).select("seg", "key"))
    rest = counts.filter(F.col("n") <= SPLIT).select("seg", "key")
    found = lookups.select("seg", "key", "fp")
    if crowded.isEmpty():
        return found.join(rest, ["seg", "key"])
    crowded = sized(crowded)
    return found.join(crowded, ["seg", "key"]).unionByName(found.join(crowded, ["seg", "key"], "left_anti").join(rest, ["seg", "key"]))


def bounded_groups(members: DataFrame, distance: int, segments: int, space: Space) -> DataFrame:
    """``members`` (seg, key, fp) dealt over groups (seg, key, path) of about SPLIT fingerprints at most.

    Fingerprints of a bucket that are within ``distance`` bits agree in one of ``distance`` + 1 pieces of the bits
    outside the segment.  A group above CUT * SPLIT puts each member into one group per piece, keyed by the bits there;
    what is left of the bits is cut again while a group is that large.  Smaller ones, and those without bits
    left, are dealt into parts, and every two parts meet in a group.  Each close pair stays together in some group.
    """
    outside, width = F.lit(None).cast("bigint"), F.lit(None).cast("int")
    for j, (shift, size, _) in enumerate(_segments(segments, distance)):
        low = F.col("fp").bitwiseAND(F.lit((1 << shift) - 1))
        high = F.shiftleft(F.shiftrightunsigned("fp", shift + size), shift) if shift + size < BITS else F.lit(0).cast("bigint")
        outside = F.when(F.col("seg") == j, low.bitwiseOR(high)).otherwise(outside)
        width = F.when(F.col("seg") == j, F.lit(BITS - size)).otherwise(width)
    path = ["seg", "key", "path"]
    now = space.write(members.select(
        "seg", "key", F.lit(0).cast("bigint").alias("path"), "fp", outside.alias("bits"), width.cast("int").alias("width")))
    done = None
    while True:
        sizes = now.groupBy(*path).agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("most"))
        cut = (F.col("n") > CUT * SPLIT) & (F.col("most") > distance)
        large = space.write(sizes.filter(F.col("n") > SPLIT).select(*path, "n", cut.alias("cut")))
        if large.isEmpty():
            rest = now.select(*path, "fp")
            return rest if done is None else done.unionByName(rest)
        again = not large.filter("cut").isEmpty()
        large = sized(large)
        parts = F.ceil(F.col("n") * 3 / SPLIT).cast("int")
        part, other = F.pmod(F.xxhash64("fp"), parts).cast("int"), F.explode(F.sequence(F.lit(0), parts - 1))
        met = now.join(large.filter("not cut"), path).withColumn("part", part).withColumn("other", other).select(
            "seg", "key", F.xxhash64("path", F.least("part", "other"), F.greatest("part", "other")).alias("path"), "fp")
        ready = space.write(now.join(large.select(*path), path, "left_anti").select(*path, "fp").unionByName(met))
        done = ready if done is None else done.unionByName(ready)
        if not again:
            return done
        pieces = now.join(large.filter("cut").select(*path), path, "left_semi").withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(distance))))
        start, stop = (f"cast(floor(width * {x} / {distance + 1}) as int)" for x in ("piece", "(piece + 1)"))
        now = space.write(
            pieces.withColumn("start", F.expr(start)).withColumn("stop", F.expr(stop))
            .withColumn("own", F.expr("shiftrightunsigned(bits, start) & (shiftleft(1L, stop - start) - 1)"))
            .select("seg", "key", F.xxhash64("path", "piece", "own").alias("path"), "fp",
                    F.expr("(bits & (shiftleft(1L, start) - 1)) | shiftleft(shiftrightunsigned(bits, stop), start)").alias("bits"),
                    F.expr("width - (stop - start)").alias("width")))


def links(prints: DataFrame, distance: int = 4, segments: int = 3) -> DataFrame:
    """Edges (a, b) between the distinct values of ``prints`` (column ``fp``): enough of the pairs within
    ``distance`` bits to connect whatever all of them connect.

    Multi-index hashing: a table per segment holds the fingerprints by the bits of that segment; each
    fingerprint looks up the Hamming ball around its own bits (of radius one only the half with a bit
    set more, the other half finds it from the other side), and complete distances decide.
    Buckets of many fingerprints are not paired but clustered, in groups of bounded size, which gives one edge per
    fingerprint and group.
    """
    fp = F.col("fp")
    stored, probes = [], []
    for j, (shift, width, radius) in enumerate(_segments(segments, distance)):
        key = _field(fp, shift, width)
        stored.append(F.struct(F.lit(j).alias("seg"), key.alias("key")))
        probes.append(_ball(j, key, width if radius else 0))
    table = prints.select("fp", F.inline(F.array(*stored)))
    lookups = prints.select("fp", F.inline(F.flatten(F.array(*probes))))
    space = Space(prints.sparkSession)
    counts = space.write(table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > DENSE))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance
    light = (
        lookups.join(table.join(counts, ["seg", "key"], "left_anti").withColumnRenamed("fp", "other"), ["seg", "key"])
        .filter(close & (~F.col("own") | (F.col("fp") < F.col("other"))))
        .select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b"))
    )
    groups = bounded_groups(_members(lookups, counts, space), distance, segments, space)

    def stars(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(pdf["fp"].to_numpy(np.int64))
        root = _cluster(fps, distance)
        moved = root != fps
        return pd.DataFrame({"a": fps[moved], "b": root[moved]})

    dense = groups.groupBy("seg", "key", "path").applyInPandas(stars, "a bigint, b bigint")
    return light.unionByName(dense).distinct()


def near_copies(entities: DataFrame, distance: int = 4, width: int = 4, segments: int = 3) -> DataFrame:
    """Fingerprint and near-copy class of every entity.

    ``entities`` has ``entity_id`` and ``text`` (other columns are ignored).  Words are what lies between
    ASCII blanks, A-Z lower-cased; shingles have ``width`` words, repeats count (fewer words: the whole
    sequence).  Two entities are linked if their fingerprints differ in ``distance`` bits or fewer.
    Returns one row per input row: entity_id, fingerprint (bigint), component_id, the smallest entity_id
    reachable over links.  Null and empty texts have fingerprint zero and are linked like others.
    Null ids keep their row; a class of null ids only has a null component_id.

    ``segments`` should grow the tables with the corpus: 64 / segments bits address a bucket.
    """
    space = Space(entities.sparkSession)
    docs = space.write(fingerprints(entities, width).withColumnRenamed("fingerprint", "fp"))
    classes = space.write(docs.groupBy("fp").agg(F.min("entity_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(links(classes.select("fp"), distance, segments), space).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = space.write(rooted.join(smallest, "root").select("fp", "component_id", "n"))
    return heavy_join(docs, named, "fp", "n").select("entity_id", F.col("fp").alias("fingerprint"), "component_id")


def _node(words: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(words)).digest()


def _per_text(rows: DataFrame, names: list[str], schema: T.StructType, each) -> DataFrame:
    """``names`` of ``rows`` and what ``each`` makes of the words of column ``text``, some texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                found = each([_words(x.as_py()) for x in part.column(len(names))])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), *found], schema.names)

    return rows.select(*names, "text").mapInArrow(run, schema)


def _distinct(words: list[bytes], width: int) -> np.ndarray:
    return np.unique(_shingles(words, width)).view(np.int64)


def _ids(words: list[list[bytes]]) -> pa.Array:
    """64 bits of the identity of each word sequence."""
    return pa.array([int.from_bytes(_node(w)[:8], "little", signed=True) for w in words], pa.int64())


def text_sizes(entities: DataFrame, width: int) -> DataFrame:
    """(entity_id, node, id, size) of every row: identity of its word sequence, 64 bits of it, number of distinct shingles."""
    schema = T.StructType([
        entities.schema["entity_id"], T.StructField("node", T.BinaryType()), T.StructField("id", T.LongType()),
        T.StructField("size", T.LongType())])
    return _per_text(entities, ["entity_id"], schema, lambda words: [
        pa.array([_node(w) for w in words], pa.binary()), _ids(words),
        pa.array([len(_distinct(w, width)) for w in words], pa.int64())])


def shingle_sets(entities: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of every row; the distinct shingle hashes are made anew, being larger than the texts."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
    return _per_text(entities, [], schema, lambda words: [
        _ids(words), pa.array([_distinct(w, width) for w in words], pa.list_(pa.int64()))])


def _least_common(size: Column, similarity: float) -> Column:
    """Shingles that a set of ``size`` must share with any set as similar as that."""
    return F.ceil(size * F.lit(similarity) - F.lit(1e-6)).cast("int")


def _candidates(texts: DataFrame, sizes: DataFrame, similarity: float, space: Space) -> DataFrame:
    """(id, size, shared, rare) of the ``texts`` (id, shingles; repeats do no harm) that may be similar to another one.

    ``shared`` are the shingles that another text has too, rarest first.  A text whose others are too many
    is similar to none and is left out.  Two similar texts have one of their first ``rare`` shingles in common: if the
    first common one came later in either, fewer than necessary would be left behind it.
    """
    terms = texts.select("id", F.explode("shingles").alias("shingle"))
    counted = terms.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("shingle"))).filter("n > 1")
    shared = counted.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("n", "shingle"))).alias("shared"))
    need = _least_common(F.col("size"), similarity)
    return space.write(
        shared.join(sizes.hint("merge"), "id")
        .filter(F.size("shared") >= need)
        .select("id", "size", F.col("shared.shingle").alias("shared"), (F.size("shared") - need + 1).alias("rare")))


def _linked(size: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Position of a set that each of ``sets`` is linked with by chains inside the list; ``size`` counts further members of each."""
    root, left = np.arange(len(sets)), np.arange(len(sets))
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sets = np.split(codes, np.cumsum([len(x) for x in sets])[:-1])
    kinds = int(codes.max()) + 1

    def index(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Holders of every code, side by side, and where those of a code begin."""
        code = np.concatenate([sets[i] for i in of])
        holder = np.repeat(of, [len(sets[i]) for i in of])
        return holder[np.argsort(code, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(code, minlength=kinds))])

    holders, start = index(left)
    indexed = len(left)
    while len(left):
        queue, top = [left[0]], left[0]
        left = left[1:]
        while queue and len(left):
            if len(left) * FEW <= indexed:
                holders, start = index(left)
                indexed = len(left)
            now = queue.pop()
            begin, n = start[sets[now]], start[sets[now] + 1] - start[sets[now]]
            at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            common = np.bincount(holders[at], minlength=len(sets))[left]
            near = (common > 0) & (common >= (size[left] + size[now] - common) * similarity)
            hit = left[near]
            if len(hit):
                left = left[~near]
                root[hit] = top
                queue.extend(hit.tolist())
    return root


def similar_links(texts: DataFrame, sizes: DataFrame, space: Space, similarity: float) -> DataFrame:
    """Edges (a, b) between the ids of ``texts`` (id, shingles) of at least that Jaccard similarity, enough to connect what all of them connect.

    ``sizes`` has the number of shingles of each id once.

    Texts that share one of their rare shingles, and chains of such texts, form a group; no similar pair leaves it.
    A group is clustered in one task by complete sets.  A large one is dealt over parts, of which every two meet.
    """
    found = _candidates(texts, sizes, similarity, space)
    rare = space.write(found.select("id", F.explode(F.slice("shared", F.lit(1), F.col("rare"))).alias("shingle")))
    holders = rare.groupBy("shingle").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    chains = components(heavy_join(rare, space.write(holders), "shingle", "n").select(F.col("id").alias("a"), "b"), space)
    groups = chains.unionByName(chains.select(F.col("root").alias("node"), "root").distinct())
    members = space.write(found.select("id", "size", "shared").hint("merge").join(groups.withColumnRenamed("node", "id"), "id"))
    space.drop(found)

    totals = members.groupBy("root").agg(F.sum(F.size("shared")).alias("total"), F.count(F.lit(1)).alias("n"))
    most = totals.agg(F.sum("total")).first()[0] or 0
    parts = F.least(F.greatest(F.ceil(F.col("total") * 3 / SHARE), F.lit(PARTS)), F.col("n")).cast("int")
    large = space.write(totals.filter(F.col("total") > min(SHARE, most // HOT)).select("root", parts.alias("parts")))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = (
        members.join(F.broadcast(large), "root").withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("id", "size", "shared", "root", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q")))
    whole = members.join(F.broadcast(large.select("root")), "root", "left_anti").select(
        "id", "size", "shared", "root", F.lit(0).alias("p"), F.lit(0).alias("q"))

    def stars(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group["id"].to_numpy()
        sets = [x.values.to_numpy() for chunk in group["shared"].chunks for x in chunk]
        root = _linked(group["size"].to_numpy().astype(np.int64), sets, similarity)
        moved = root != np.arange(len(ids))
        return pa.table({"a": pa.array(ids[moved], pa.int64()), "b": pa.array(ids[root[moved]], pa.int64())})

    return whole.unionByName(dealt).groupBy("root", "p", "q").applyInArrow(stars, "a bigint, b bigint")


def similar_copies(entities: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """Near-copy class of every entity by the similarity of the texts.

    ``entities`` has ``entity_id`` and ``text`` (other columns are ignored).  Words and shingles are those of
    ``near_copies``, ``width`` words each.  Entities of equal words are one text; texts are linked if the Jaccard
    similarity of their sets of shingles is at least ``similarity``, and no such link is missed.
    Returns one row per input row: entity_id, component_id, the smallest entity_id reachable, node, the identity of
    the row's words, and root, the number of its class (ids may repeat, so a component_id may name several classes).
    Null and empty texts are one text without shingles, linked with no other.  Null ids
    keep their row; a class of null ids only has a null component_id.
    """
    space = Space(entities.sparkSession)
    docs = space.write(text_sizes(entities, width))
    classes = space.write(docs.groupBy("node").agg(
        F.min("entity_id").alias("first"), F.min("id").alias("id"), F.min("size").alias("size"), F.count(F.lit(1)).alias("n")))
    wanted = sized(classes.select(F.col("first").alias("e")).distinct())
    texts = shingle_sets(entities.join(wanted, entities.entity_id.eqNullSafe(wanted.e), "left_semi"), width)
    sizes = classes.groupBy("id").agg(F.max("size").alias("size"))
    edges = similar_links(texts, sizes, space, similarity)
    rooted = classes.join(components(edges, space).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = space.write(rooted.join(smallest, "root").select("node", "component_id", "root", "n"))
    return heavy_join(docs.select("entity_id", "node"), named, "node", "n").select("entity_id", "component_id", "node", "root")


def with_nodes(rows: DataFrame) -> DataFrame:
    """``rows`` and the identity of the words of column ``text``, in column ``node`` as ``similar_copies`` has it."""
    schema = T.StructType([*rows.schema.fields, T.StructField("node", T.BinaryType())])
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = pa.array([_node(_words(x.as_py())) for x in b.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, nodes], schema.names)

    return rows.mapInArrow(run, schema)
