"""Product codes of entity vectors in whole numbers: exact products by limbs, exact means."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spandoc.llm.common import Space, heavy_join

# Whole numbers up to this many bits are exact in float64; rows multiplied at once.
EXACT_BITS, ROWS = 53, 4096


def _limbs(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """``a`` as a sum of limbs times 2^(bits * position), all but the last from 0 to 2^bits - 1, as floats."""
    out = []
    while len(a) and np.abs(a).max() >= 1 << bits:
        out.append((a & ((1 << bits) - 1)).astype(np.float64))
        a = a >> bits
    return [*out, a.astype(np.float64)]


def limb_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two int64 matrices, exact as long as they fit in 64 bits.

    Limbs are so short that a sum of their products over a row stays below 2^53, where float64 BLAS is
    exact in any order of summation; the products are put together again in int64.
    """
    bits = (EXACT_BITS - left.shape[1].bit_length()) // 2
    out = np.zeros((len(left), len(right)), np.int64)
    rights = _limbs(right, bits)
    for i, a in enumerate(_limbs(left, bits)):
        for j, b in enumerate(rights):
            out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(part: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``codebook`` (ties to the lower one) and the squared distance to it."""
    distance = (codebook * codebook).sum(1)[None, :] - 2 * limb_products(part, codebook)
    index = distance.argmin(1)  # the first of equal ones
    return index, distance[np.arange(len(part)), index] + (part * part).sum(1)


@dataclass(frozen=True)
class Compression:
    """``codes``: one row per kept vector; ``codebooks``: int64 array (part, entry, position)."""

    codes: DataFrame
    codebooks: np.ndarray

    def codebooks_text(self) -> str:
        """All components in decimal by part, entry and position, joined by commas."""
        return ",".join(map(str, self.codebooks.ravel().tolist()))


def compress_vectors(entities: DataFrame, group: str = "grp", parts: int = 4, entries: int = 256, rounds: int = 4,
                     scale: int = 1024) -> Compression:
    """Code every vector by the nearest entries of ``parts`` codebooks of at most ``entries`` (up to 256) entries.

    ``entities`` has ``entity_id``, ``embedding`` (array of numbers) and the column ``group``; other
    columns are ignored.  Components become floor(scale * x), vectors are cut into ``parts`` equal consecutive
    parts.  A codebook starts as that part of the ``entries`` smallest ids (rows of one id by their
    vectors, null ids last; fewer rows give fewer entries); each of ``rounds`` rounds assigns all parts and
    replaces each entry by the floor of the mean of its parts, entries without parts stay.  The
    last assignment gives the codes.

    ``codes`` has entity_id, group, code (two hex digits per part), error (bigint, squared distance over all
    parts) and ``<group>_error`` (bigint, error summed over the rows of equal group, nulls together).
    Vectors that are null or hold null or non-finite components have no row.  Repeated rows are rows of
    their own.  The common length is the one most vectors have among the positive multiples of
    ``parts`` (ties to the shorter); vectors of another length, and those with components too
    large for a squared distance in 64 bits, have a row with null code and error, which no sum
    counts.  A sum beyond 64 bits is null.  No table of vectors gives no rows and codebooks without entries.

    What the driver holds is the codebooks: ``entries`` times the length of a vector.  Tasks add up
    their own parts first, so a shuffle carries one row per task, part and entry.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits hold up to 256 entries")
    spark = entities.sparkSession
    space = Space(spark)
    x = F.transform("embedding", lambda v: F.lit(scale) * v.cast("double"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    given = entities.select("entity_id", F.col(group).alias("grp"), "embedding").filter(F.col("embedding").isNotNull() & fine)
    sizes = given.filter((F.size("embedding") > 0) & (F.size("embedding") % parts == 0)).groupBy(F.size("embedding").alias("d"))
    common = sizes.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    length = common["d"] if common else parts
    width = length // parts
    # (2 * largest)^2 * length stays below 2^62; a component fits in 32 bits.
    largest = min(1 << 30, isqrt((1 << 60) // length))
    coded = (F.size("embedding") == length) & F.forall(x, lambda v: F.abs(v) < largest)
    rows = space.write(given.select(
        "entity_id", "grp", F.when(coded, F.transform(x, lambda v: F.floor(v).cast("int"))).alias("v")))
    usable = rows.filter(F.col("v").isNotNull())
    seeds = usable.orderBy(F.col("entity_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.array([r.v for r in seeds], np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2)
    for _ in range(rounds if len(seeds) else 0):
        books = _moved(usable, books)
    coded_rows = space.write(_coded(usable, books).unionByName(
        rows.filter(F.col("v").isNull()).select("entity_id", "grp", F.lit(None).cast("string").alias("code"),
                                                F.lit(None).cast("bigint").alias("error"))).withColumn("key", _null_safe("grp")))
    sums = coded_rows.groupBy("key").agg(F.try_sum("error").alias("sum"), F.count(F.lit(1)).alias("rows"))
    out = heavy_join(coded_rows, space.write(sums), "key", "rows").select(
        "entity_id", F.col("grp").alias(group), "code", "error", F.col("sum").alias(f"{group}_error"))
    return Compression(out, books)


def _null_safe(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def _matrices(column: pa.Array, length: int) -> Iterator[np.ndarray]:
    for lo in range(0, len(column), ROWS):
        yield np.asarray(column.slice(lo, ROWS).flatten(), np.int64).reshape(-1, length)


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            for v in _matrices(b.column(0), parts * width):
                for p in range(parts):
                    part = v[:, p * width:(p + 1) * width]
                    index, _ = nearest(part, shared.value[p])
                    order = np.argsort(index, kind="stable")
                    used, starts = np.unique(index[order], return_index=True)
                    sums[p, used] += np.add.reduceat(part[order], starts)
                    counts[p] += np.bincount(index, minlength=entries)
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_arrays(
                [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))],
                names=["part", "entry", "n", "sums"])

    partial = rows.select("v").mapInArrow(tally, "part int, entry int, n bigint, sums array<bigint>")
    total = partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
    out = books.copy()
    for r in total.collect():  # one row per entry of a codebook
        out[r.part, r.entry] = np.array(r.sums, np.int64) // r.n
    return out


def _coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    parts, _, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, errors = [], []
            for v in _matrices(b.column(2), parts * width):
                found = [nearest(v[:, p * width:(p + 1) * width], shared.value[p]) for p in range(parts)]
                errors.append(sum(distance for _, distance in found))
                codes += [c.tobytes().hex() for c in np.stack([index for index, _ in found], 1).astype(np.uint8)]
            if codes:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(codes), pa.array(np.concatenate(errors))],
                    names=["entity_id", "grp", "code", "error"])

    kept = [f"{n} {t}" for n, t in rows.dtypes if n != "v"]
    return rows.mapInArrow(run, ", ".join([*kept, "code string", "error bigint"]))
