"""Exact top-k inner products: threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spandoc.llm.common import Space

EXACT = float(1 << 53)


def _products(rows: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    return np.rint(rows @ query).astype(np.int64) if exact else rows.astype(np.int64) @ query.astype(np.int64)


class SortedLists:
    """A block of vectors with one list per dimension, sorted by that component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()  # ascending, one row per dimension
        self.sorted = np.take_along_axis(vectors.T, self.order, axis=1)

    def search(self, own: int, query: np.ndarray, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, ties to smaller ids; the row of id ``own`` takes no part.

        All lists are walked together from the end that suits the sign of the query's component.
        Rows seen for the first time are scored in full; no unseen row can score above the sum of
        the products at the current depth, so the walk ends once the k-th score is above it.
        """
        n = len(self.ids)
        active = np.flatnonzero(query)
        down = query[active] > 0
        seen = self.ids == own
        best_ids, best = np.empty(0, self.ids.dtype), np.empty(0, np.int64)
        depth, step = 0, 16
        while depth < n:
            end = min(n, depth + step)
            lists = np.where(down[:, None], self.order[active, n - end:n - depth], self.order[active, depth:end])
            fresh = np.zeros(n, bool)
            fresh[lists.ravel() if len(active) else slice(None)] = True  # a zero query has no list to walk
            fresh = np.flatnonzero(fresh & ~seen)
            seen[fresh] = True
            best_ids = np.concatenate([best_ids, self.ids[fresh]])
            best = np.concatenate([best, _products(self.vectors[fresh], query, exact)])
            top = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[top], best[top]
            at = np.where(down, self.sorted[active, n - end], self.sorted[active, end - 1])
            if seen.all() or len(best) == k and best[-1] > _products(at[None, :], query[active], exact)[0]:
                break
            depth, step = end, step * 4
        return best_ids, best


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024,
                block: int = 16_384, query_block: int = 8_192) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product with each row of ``queries``.

    Both have ``entity_id`` (integer) and ``embedding`` (array of numbers); other columns are ignored.
    Components become floor(scale * x).  Returns query_id, rank (from 1), entity_id, score (bigint), ties to
    the smaller entity_id; a query never finds rows of its own id.  Vectors that are null, empty or hold
    null or non-finite components take no part, nor do null ids; vectors of different lengths never
    meet.  Repeated ids are rows of their own; a repeated query id answers once per row.  Scores must
    fit 64-bit integers.

    Candidates are dealt into blocks of about ``block`` rows by their id, queries into blocks of
    ``query_block``; each pair of blocks is one task's work, and only its k best per query go on.
    """
    space = Space(vectors.sparkSession)
    x = F.col("embedding")
    whole = F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")))

    def usable(df: DataFrame) -> DataFrame:
        fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
        return space.write(
            df.filter(F.col("entity_id").isNotNull() & (F.size(x) > 0) & fine)
            .select(F.col("entity_id").cast("bigint").alias("entity_id"), whole.alias("v"), F.size(x).alias("dim")))

    rows = usable(vectors)
    # Equal queries are answered once; the digest tells different vectors of one id apart.
    asked = space.write(
        usable(queries).groupBy("entity_id", "v", "dim").agg(F.count(F.lit(1)).cast("int").alias("copies"))
        .withColumn("digest", F.xxhash64("v")))
    n, m = rows.count(), asked.count()
    blocks, asks = max(1, -(-n // block)), max(1, -(-m // query_block))

    def deal(df: DataFrame, parts: int):
        return df.withColumn("part", F.pmod(F.xxhash64("entity_id"), F.lit(parts)).cast("int"))

    def everywhere(df: DataFrame, name: str, parts: int):
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    left = everywhere(deal(rows, blocks).withColumnRenamed("part", "b"), "q", asks)
    right = everywhere(deal(asked, asks).withColumnRenamed("part", "q"), "b", blocks)

    def matrix(t: pa.Table) -> np.ndarray:
        return np.asarray(t["v"].combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)

    def search(these: pa.Table, those: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if these.num_rows and those.num_rows:
            v, q = matrix(these), matrix(those)
            exact = bool(np.abs(v).max() * np.abs(q).max() * v.shape[1] < EXACT)
            if not exact:
                v, q = (np.stack([np.array(r, np.int64) for r in t["v"].to_pylist()]) for t in (these, those))
            lists = SortedLists(np.asarray(these["entity_id"], np.int64), v)
            for own, digest, copies, query in zip(*(those[c].to_pylist() for c in ("entity_id", "digest", "copies")), q):
                ids, scores = lists.search(own, query, k, exact)
                out += [(own, digest, copies, i, s) for i, s in zip(ids.tolist(), scores.tolist())]
        cols = list(zip(*out)) if out else [()] * 5
        return pa.table({n: pa.array(c, pa.int32() if n == "copies" else pa.int64()) for n, c in zip(
            ("query_id", "digest", "copies", "entity_id", "score"), cols)})

    keys = ["dim", "b", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        search, "query_id bigint, digest bigint, copies int, entity_id bigint, score bigint")
    w = Window.partitionBy("query_id", "digest").orderBy(F.desc("score"), "entity_id")
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "entity_id", "score", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")
