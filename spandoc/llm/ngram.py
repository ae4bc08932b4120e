"""Language-model scores: word trigrams mixed by deleted interpolation, beside a smoothed unigram model.

Tokens are words (between ASCII blanks, A-Z lower-cased) and one end per text; each is predicted from the two before
it.  All words, bigrams and trigrams of the corpus are counted.  A word is known by 64 bits of its xxhash, a bigram or
trigram by 64 bits mixed from those of its words.  P(word) keeps back, for the one unknown word, what kept-back texts
show to be new words.

Texts are stored as batches of word numbers.  A batch asks for the counts of its distinct grams, one order after the
other: its own counts meet those of all batches in the task of a range of grams, and the totals go back to the batch.  So a
frequent gram is one entry per batch, and no row stands for a single token.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from spandoc.llm.common import Space

END = 0  # the end of a text is the start of the next
LEVELS = 3  # histories of no, one and two tokens
BUCKETS = 48  # of context frequencies, by powers of two
CHUNK = 2_000_000  # bytes of text in a batch
KNOWN = 1_000_000  # words whose numbers a task remembers
RANGE = 1_500_000  # grams of a range, at most, that all batches ask for


class _Numbers(dict):
    """Numbers of the words met so far."""

    def __missing__(self, word: bytes | None) -> int:
        from xxhash import xxh64_intdigest

        n = END if word is None else xxh64_intdigest(word) or 1
        self[word] = n
        return n


def _batches(docs: DataFrame) -> DataFrame:
    """``docs`` (entity_id, part, text) as batches of texts of one part.

    ``ids`` and ``lengths`` have an entry per text, ``numbers`` are the distinct words, ``at`` has the place of every token among them.
    """
    rows = docs.select("entity_id", "part", "text")
    schema = T.StructType([
        T.StructField("batch", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(rows.schema["entity_id"].dataType)), T.StructField("lengths", T.BinaryType()),
        T.StructField("numbers", T.BinaryType()), T.StructField("at", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, done = _Numbers(), TaskContext.get().partitionId() << 32
        ids, lengths, flat, size = ({p: [] for p in (-1, 0, 1)} for _ in range(4))

        def finished(part: int) -> pa.RecordBatch:
            nonlocal done
            tokens = np.concatenate(flat[part])
            words, at = np.unique(tokens, return_inverse=True)
            listed = pa.concat_arrays(ids[part])
            done += 1
            out = pa.RecordBatch.from_arrays([
                pa.array([done - 1]), pa.array([part], pa.int32()), pa.array([len(tokens)]),
                pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed),
                pa.array([np.array(lengths[part], np.int32).tobytes()]), pa.array([words.tobytes()]),
                pa.array([at.astype(_width(len(words))).tobytes()])], schema.names)
            for x in (ids, lengths, flat, size):
                x[part] = []
            return out

        for b in batches:
            for i, (part, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2))):
                raw = (text.as_py() or "").encode()
                words = raw.lower().split()
                words.append(None)
                ids[part].append(b.column(0).slice(i, 1))
                lengths[part].append(len(words))
                flat[part].append(np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words)))
                size[part].append(len(raw))
                if len(numbers) > KNOWN:
                    numbers.clear()
                if len(size[part]) % 64 == 0 or len(raw) > CHUNK // 64:
                    size[part] = [sum(size[part])]
                    if size[part][0] >= CHUNK:
                        yield finished(part)
        for part in ids:
            if ids[part]:
                yield finished(part)

    return rows.mapInArrow(run, schema)


def _width(words: int) -> type:
    return np.uint16 if words <= 1 << 16 else np.uint32


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits that stand for a pair of 64-bit numbers."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(numbers: bytes, at: bytes, level: int) -> np.ndarray:
    """For every token of a batch, the gram that ends with it: of one, two or three tokens by ``level``."""
    words = np.frombuffer(numbers, np.uint64)
    w = words[np.frombuffer(at, _width(len(words)))]
    end = np.array([END], np.uint64)
    if level == 0:
        return _mix(end, w)  # spread over the whole range
    v = np.concatenate([end, w[:-1]])
    if level == 1:
        return _mix(v, w)
    u = np.concatenate([end, end, w[:-2]])[:len(w)]
    u[v == END] = END
    return _mix(_mix(u, v), w)


def _packed(counts: np.ndarray) -> bytes:
    """Counts, a byte each; those above 254 follow in full."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return np.array([len(counts)], np.int64).tobytes() + small.tobytes() + counts[small == 255].astype(np.int64).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    small = np.frombuffer(raw, np.uint8, n, 8)
    counts = small.astype(np.int64)
    counts[small == 255] = np.frombuffer(raw[8 + n:], np.int64)
    return counts


def _ranges(n_tokens: int) -> int:
    return max(1, ceil(n_tokens / RANGE))


def _totals(batches: DataFrame, level: int, ranges: int) -> DataFrame:
    """Per batch and range of grams, how often each distinct gram of the batch, in order, is in part 0 and in part 1 of all texts.

    ``types`` are the distinct grams of both parts in the range of a task, on one of its rows.
    """

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["batch", "part", "range", "grams", "counts"]
        first = np.array([i * (1 << 64) // ranges for i in range(ranges)], dtype=np.uint64)
        for b in rows:
            for batch, part, numbers, at in zip(*(c.to_pylist() for c in b.columns)):
                grams, counts = np.unique(_keys(numbers, at, level), return_counts=True)
                cut = [*np.searchsorted(grams, first).tolist(), len(grams)]
                some = [(i, x, y) for i, (x, y) in enumerate(zip(cut, cut[1:])) if x < y]
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch] * len(some)), pa.array([part] * len(some), pa.int32()), pa.array([i for i, _, _ in some], pa.int32()),
                    pa.array([grams[x:y].tobytes() for _, x, y in some], pa.binary()),
                    pa.array([_packed(counts[x:y]) for _, x, y in some], pa.binary())], names)

    def answer(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["batch", "part", "range", "n0", "n1", "types"]
        asked = [r for b in rows for r in zip(*(c.to_pylist() for c in b.columns))]
        if not asked:
            return
        sizes = [len(r[3]) // 8 for r in asked]
        grams, at = np.unique(np.concatenate([np.frombuffer(r[3], np.uint64) for r in asked]), return_inverse=True)
        counts = np.concatenate([_unpacked(r[4]) for r in asked])
        part = np.repeat([r[1] for r in asked], sizes)
        n = [np.bincount(at, counts * (part == p), len(grams)).astype(np.int64) for p in (0, 1)]
        cut, types = np.cumsum([0, *sizes]), int(np.count_nonzero(n[0] + n[1]))
        for i, (batch, own, number, _, _) in enumerate(asked):
            here = at[cut[i]:cut[i + 1]]
            yield pa.RecordBatch.from_arrays([
                pa.array([batch]), pa.array([own], pa.int32()), pa.array([number], pa.int32()), pa.array([_packed(n[0][here])]),
                pa.array([_packed(n[1][here])]), pa.array([0 if i else types])], names)

    asked = batches.select("batch", "part", "numbers", "at").mapInArrow(ask, "batch long, part int, range int, grams binary, counts binary")
    return asked.repartition(ranges, "range").mapInArrow(
        answer, "batch long, part int, range int, n0 binary, n1 binary, types long").withColumn("level", F.lit(level))


def _counted(own: pa.Table, totals: pa.Table) -> tuple[dict, dict[tuple[str, int], np.ndarray], list[np.ndarray]]:
    """A batch, the counts of its tokens' grams by (name, part) and, by level, its grams' places.

    Names: own (n), of the history (h), of the last two words (c), of the history of these (m), of the last word (s).
    """
    row = own.to_pylist()[0]
    found = sorted(zip(*(totals.column(c).to_pylist() for c in ("level", "range", "n0", "n1"))), key=lambda r: r[:2])
    counts, places = {}, []
    for level, name in enumerate("scn"):
        at = np.unique(_keys(row["numbers"], row["at"], level), return_inverse=True)[1]
        places.append(at)
        for p in (0, 1):
            all_grams = np.concatenate([_unpacked(r[2 + p]) for r in found if r[0] == level])
            counts[name, p] = all_grams[at].astype(float)
    words = np.frombuffer(row["numbers"], np.uint64)
    first = np.roll(words[np.frombuffer(row["at"], _width(len(words)))] == END, 1)  # follows an end, as the batch's last token is
    for p in (0, 1):
        # A token is the history of what follows it, an end that of the first token of a text.
        s, c = counts["s", p], counts["c", p]
        counts["m", p] = np.roll(s, 1)
        counts["h", p] = np.where(first, s[-1], np.roll(c, 1))
    return row, counts, places


def _share(n: np.ndarray, total: np.ndarray | float) -> np.ndarray:
    return np.divide(n, total, out=np.zeros(len(n)), where=np.broadcast_to(np.asarray(total) > 0, n.shape))


def _bucket(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, np.minimum(np.frexp(n)[1], BUCKETS - 1), 0).astype(np.int32)


def _levels(counts: dict, parts: tuple[int, ...], tokens: int) -> list[np.ndarray]:
    """Frequencies and context buckets of the levels, from the counts of some parts."""
    n, h, c, m, s = (sum(counts[x, p] for p in parts) for x in "nhcms")
    lowest = np.full(len(n), int(tokens > 0), np.int32)
    return [_share(s, float(tokens)), _share(c, m), _share(n, h), lowest, _bucket(m), _bucket(h)]


def mixed(frequency: list[np.ndarray], weight: list[np.ndarray]) -> list[np.ndarray]:
    """Probabilities of the levels: each mixes its frequency with the level below; below the lowest is the unknown word."""
    p, out = (frequency[0] == 0).astype(float), []
    for f, w in zip(frequency, weight):
        p = w * f + (1 - w) * p
        out.append(p)
    return out


def learn_weights(grams: DataFrame, rounds: int = 8) -> np.ndarray:
    """Mixture weights [level, bucket] by expectation-maximisation on kept-back grams.

    ``grams`` has, per level from the lowest, the frequency (f0, ...) and the bucket of the context (b0, ...), and n.
    Every round adds up, over all grams, how often the walk from the longest history down
    reaches a level and how often it stops there; only these LEVELS * BUCKETS sums come to the driver.
    """
    weights = np.full((LEVELS, BUCKETS), 0.5)
    weights[:, 0] = 0.0  # contexts never seen
    space = Space(grams.sparkSession)
    table = space.write_swept(grams)
    learned = np.zeros(weights.shape, bool)
    for _ in range(rounds):
        sums = table.mapInArrow(_expectation(weights.copy()), "level int, bucket int, stopped double, reached double")
        sums = sums.groupBy("level", "bucket").agg(F.sum("stopped").alias("stopped"), F.sum("reached").alias("reached"))
        for r in sums.collect():
            if r.bucket and r.reached > 0:
                least, most = (0.001, 0.999) if r.level == 0 else (0.0, 0.9999)
                weights[r.level, r.bucket] = min(most, max(least, r.stopped / r.reached))
                learned[r.level, r.bucket] = True
    space.drop(table)
    for level in range(LEVELS):
        for b in range(2, BUCKETS):  # more frequent than any context met
            if not learned[level, b] and learned[level, 1:b].any():
                weights[level, b] = weights[level, b - 1]
    return weights


def _expectation(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stopped, reached = np.zeros((LEVELS, BUCKETS)), np.zeros((LEVELS, BUCKETS))
        for b in batches:
            cols = [np.asarray(c) for c in b.columns]
            f, k, left = cols[:LEVELS], cols[LEVELS:2 * LEVELS], cols[-1]
            lam = [weights[i][k[i]] for i in range(LEVELS)]
            p = mixed(f, lam)
            for i in reversed(range(LEVELS)):
                stop = left * lam[i] * f[i] / p[i]
                stopped[i] += np.bincount(k[i], stop, BUCKETS)
                reached[i] += np.bincount(k[i], left, BUCKETS)
                left = left - stop
        at = np.flatnonzero(reached)
        yield pa.RecordBatch.from_arrays(
            [pa.array((at // BUCKETS).astype(np.int32)), pa.array((at % BUCKETS).astype(np.int32)),
             pa.array(stopped.ravel()[at]), pa.array(reached.ravel()[at])], ["level", "bucket", "stopped", "reached"])

    return run


def score_texts(
    entities: DataFrame, trains: Column, kept_back: Column, sample_rows: int = 2000, common: int = 65_536,
) -> DataFrame:
    """Log10 probabilities of every text under a unigram model and an interpolated trigram model.

    ``entities`` has ``entity_id`` and ``text``; other columns are ignored.  ``trains`` and ``kept_back`` are conditions on
    entity_id: the rows to learn from, and those of them whose counts teach the mixture weights (they
    join the final counts).  Null conditions are false, null texts are empty.

    Returns per input row entity_id, n_tokens (words and one end), n_known (tokens seen in training), train_tokens,
    base_score (add-half smoothing over the V training types and one unknown type), score (the trigram model over
    the same types).  Without training rows no token is known.

    ``sample_rows`` and ``common`` are accepted for older callers and without effect: nothing is sampled or listed.
    """
    space = Space(entities.sparkSession)
    part = F.when(~F.coalesce(trains, F.lit(False)), -1).when(F.coalesce(kept_back, F.lit(False)), 1).otherwise(0)
    batches = space.write(_batches(entities.select("entity_id", "text", part.cast("int").alias("part"))))
    sizes = {r.part: r.n for r in batches.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    first, n = sizes.get(0, 0), sizes.get(0, 0) + sizes.get(1, 0)
    totals = [space.write_swept(_totals(batches, level, _ranges(sum(sizes.values())))) for level in range(LEVELS)]
    v = totals[0].agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]
    unit = log10(n + 0.5 * (v + 1))
    answers = totals[0].unionByName(totals[1]).unionByName(totals[2]).drop("types")

    names = [*(f"f{i}" for i in range(LEVELS)), *(f"b{i}" for i in range(LEVELS)), "n"]

    def kept(own: pa.Table, totals: pa.Table) -> pa.Table:
        _, counts, places = _counted(own, totals)
        _, at, times = np.unique(places[-1], return_index=True, return_counts=True)
        return pa.table([*(pa.array(x[at]) for x in _levels(counts, (0,), first)), pa.array(times.astype(float))], names)

    def per_batch(rows: DataFrame, found: DataFrame, run, schema):
        return rows.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(run, schema)

    weights = learn_weights(per_batch(
        batches.filter("part = 1"), answers.filter("part = 1"), kept, ", ".join(f"{x} {'int' if x[0] == 'b' else 'double'}" for x in names)))
    lowest = float(weights[0, 1]) if n else 0.0

    out = T.StructType([
        T.StructField("entity_id", entities.schema["entity_id"].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def scored(own: pa.Table, totals: pa.Table) -> pa.Table:
        row, counts, _ = _counted(own, totals)
        *f, _, middle, history = _levels(counts, (0, 1), n)
        s = counts["s", 0] + counts["s", 1]
        p = np.where(s > 0, lowest * f[0], 1 - lowest)
        for level, bucket in ((1, middle), (2, history)):
            weight = weights[level][bucket]
            p = weight * f[level] + (1 - weight) * p
        lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        base = np.add.reduceat(np.log10(s + 0.5), starts) - lengths * unit
        return pa.table([
            pa.array(own.column("ids")[0].values), pa.array(lengths), pa.array(np.add.reduceat((s > 0).astype(np.int64), starts)),
            pa.array(np.full(len(lengths), n)), pa.array(base), pa.array(np.add.reduceat(np.log10(p), starts))], out.names)

    return per_batch(batches, answers, scored, out)
