"""Paired bootstrap of QWK differences on compressed cells.

A row matters only through (true, rounded a, rounded b, ...): two conditions give at most 216
distinct cells, whatever the number of rows.  Resampling n rows is then a multinomial draw
over cells, so the cost is replicates x cells and never touches the data again.

``method='multinomial'`` draws each replicate in one vectorized call on the executors.
``method='keyed'`` draws every row by md5 and is for checking against other engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spandoc.functions.keyed import keyed_int
from spandoc.functions.scalar import clip_and_round
from spandoc.operators.metrics import kappa
from spandoc.operators.ordered import cut_hot, neighbours
from spandoc.plans.storage import cut_lineage

# How the drawing is dealt: cells that meet in one task, and replicates drawn there at once.
CELLS_PER_TASK = 50_000
REPLICATES_PER_TASK = 100


def joint_cells(preds: DataFrame, conditions: list[str]) -> DataFrame:
    """(t, p0, p1, ..., n): joint counts of rounded predictions, aligned by entity id.

    Entities that lack one of the conditions are left out, as in an inner join.
    """
    wanted = preds.filter(F.col("condition").isin(*conditions)).select(
        "entity_id", "condition", F.rint("y_true").cast("bigint").alias("t"),
        clip_and_round(F.col("y_pred")).alias("p"))
    wide = wanted.groupBy("entity_id", "t").agg(
        *[F.max(F.when(F.col("condition") == c, F.col("p"))).alias(f"p{i}") for i, c in enumerate(conditions)])
    names = [f"p{i}" for i in range(len(conditions))]
    return wide.na.drop(subset=names).groupBy("t", *names).agg(F.count(F.lit(1)).alias("n"))


def numbered_cells(cells: DataFrame) -> DataFrame:
    """Cells in value order with the half-open range [lo, hi) of row positions they stand for."""
    names = [c for c in cells.columns if c != "n"]
    one = cells.withColumn("one", F.lit(0))
    placed = neighbours(cut_hot(one, "one", names), names, row_number="cell", running={"lo": "n"}).finish().drop("one")
    return placed.withColumn("hi", F.col("lo") + F.col("n"))


def _keyed_draws(numbered: DataFrame, n_rows: int, n_cells: int, replicates: int, seeds: list[int]) -> DataFrame:
    spark = numbered.sparkSession
    width = max(1, n_rows // (4 * max(n_cells, 1)))
    total = n_rows * replicates * len(seeds)
    at = F.col("id")
    draws = spark.range(total).select(
        F.get(F.array(*[F.lit(s) for s in seeds]), F.floor(at / (n_rows * replicates)).cast("int")).cast("bigint").alias("seed"),
        (F.floor(at / n_rows) % replicates).cast("bigint").alias("rep"), (at % n_rows).alias("i"),
    ).select("seed", "rep", (keyed_int("seed", F.col("seed"), F.col("rep"), F.col("i"), digits=15) % n_rows).alias("idx"))
    # Range lookup as an equi-join: cells are listed under every position bucket they touch.
    spots = numbered.select("cell", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("bucket"))
    hit = draws.withColumn("bucket", F.floor(F.col("idx") / width)).join(spots, "bucket").filter(
        (F.col("idx") >= F.col("lo")) & (F.col("idx") < F.col("hi")))
    return hit.groupBy("seed", "rep", "cell").agg(F.count(F.lit(1)).alias("n"))


def _multinomial_counts(cells: DataFrame, n_rows: int, n_cells: int, replicates: int, seeds: list[int]) -> DataFrame:
    """(seed, rep, side, t, p, n) of multinomial replicates.

    The rows of a replicate are first drawn over the parts of the cell table, from (seed, replicate), then over
    the cells of each part, from (seed, replicate, part): together one draw over all cells.  The driver
    only sees the sizes of the parts, one number per CELLS_PER_TASK cells.
    """
    import numpy as np
    import pandas as pd

    names = [c for c in cells.columns if c not in ("t", "n")]
    parts = max(1, -(-n_cells // CELLS_PER_TASK))
    dealt = cells.withColumn("part", F.pmod(F.xxhash64("t", *names), F.lit(parts)).cast("int"))
    share = np.zeros(parts)
    for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect():
        share[r.part] = r.n / n_rows
    blocks = -(-replicates // REPLICATES_PER_TASK)
    tasks = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn(
        "seed", F.explode(F.array(*[F.lit(s).cast("bigint") for s in seeds])))

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        seed, part, block = (int(x) for x in key)
        pdf = pdf.sort_values(["t", *names])
        within = pdf["n"].to_numpy(float)
        within /= within.sum()
        reps = range(block * REPLICATES_PER_TASK, min(replicates, (block + 1) * REPLICATES_PER_TASK))
        counts = np.stack([
            np.random.default_rng([seed, r, part]).multinomial(np.random.default_rng([seed, r]).multinomial(n_rows, share)[part], within)
            for r in reps])
        out = []
        for side, name in enumerate(names):
            pair, at = np.unique(pdf[["t", name]].to_numpy(np.int64), axis=0, return_inverse=True)
            sums = np.zeros((len(reps), len(pair)), np.int64)
            for j, c in enumerate(at.ravel()):
                sums[:, c] += counts[:, j]
            r, c = np.nonzero(sums)
            out.append(pd.DataFrame({"seed": seed, "rep": r + reps.start, "side": side, "t": pair[c, 0], "p": pair[c, 1], "n": sums[r, c]}))
        return pd.concat(out)

    drawn = tasks.groupBy("seed", "part", "block").applyInPandas(draw, "seed bigint, rep bigint, side int, t bigint, p bigint, n bigint")
    return drawn.groupBy("seed", "rep", "side", "t", "p").agg(F.sum("n").alias("n"))


def bootstrap_differences(preds: DataFrame, a: str, others: list[str], replicates: int,
                          seeds: list[int], method: str = "multinomial") -> DataFrame:
    """(seed, rep, diff): QWK of ``a`` minus the mean QWK of ``others``, per replicate."""
    # Few rows that every step below reads: the predictions are read once.
    cells = cut_lineage(joint_cells(preds, [a, *others]))
    size = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_rows, n_cells = int(size[0]), int(size[1])
    if method == "keyed":
        numbered = numbered_cells(cells)
        drawn = _keyed_draws(numbered, n_rows, n_cells, replicates, seeds)
        sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"p{i}").alias("p")) for i in range(len(others) + 1)])
        scored = drawn.join(numbered.drop("n", "lo", "hi"), "cell").select("seed", "rep", "t", "n", F.explode(sides).alias("s"))
        flat = scored.groupBy("seed", "rep", F.col("s.side").alias("side"), "t", F.col("s.p").alias("p")).agg(F.sum("n").alias("n"))
    elif method == "multinomial":
        flat = _multinomial_counts(cells, n_rows, n_cells, replicates, seeds)
    else:
        raise ValueError(f"unknown method {method!r}")
    q = kappa(flat, ["seed", "rep", "side"])
    return q.groupBy("seed", "rep").agg(
        (F.max(F.when(F.col("side") == 0, F.col("qwk"))) - F.avg(F.when(F.col("side") > 0, F.col("qwk")))).alias("diff"))


def summarize(differences: DataFrame) -> DataFrame:
    """Mean, linear 2.5 / 97.5 percentiles and share of positive differences per seed."""
    ends = F.expr("percentile(diff, array(0.025D, 0.975D))")
    return differences.groupBy("seed").agg(
        F.avg("diff").alias("qwk_diff_mean"), ends.alias("e"),
        F.avg(F.when(F.col("diff") > 0, 1.0).otherwise(0.0)).alias("p_positive"),
    ).select("seed", "qwk_diff_mean", F.col("e")[0].alias("ci_lower"), F.col("e")[1].alias("ci_upper"), "p_positive")


def paired_bootstrap(preds: DataFrame, a: str, b: str, replicates: int = 10000, seed: int = 42,
                     method: str = "multinomial") -> DataFrame:
    return summarize(bootstrap_differences(preds, a, [b], replicates, [seed], method))


def bootstrap_vs_mean(preds: DataFrame, a: str, controls: list[str], replicates: int = 10000, seed: int = 42,
                      method: str = "multinomial") -> DataFrame:
    """Against the mean QWK of several controls within each replicate."""
    return summarize(bootstrap_differences(preds, a, controls, replicates, [seed], method))


def bootstrap_seeds(preds: DataFrame, a: str, b: str, seeds: list[int], replicates: int = 5000,
                    method: str = "multinomial") -> DataFrame:
    """One row per seed plus a row ``extra`` with one further, derived seed."""
    extra = seeds[0] ^ 99991
    rows = summarize(bootstrap_differences(preds, a, [b], replicates, [*seeds, extra], method))
    return rows.withColumn("kind", F.when(F.col("seed") == extra, "extra").otherwise("listed"))


def seed_mean(rows: DataFrame) -> DataFrame:
    """Mean of the summary columns over all seed rows."""
    return rows.agg(*[F.avg(c).alias(f"bootstrap_{c}_mean") for c in ("qwk_diff_mean", "ci_lower", "ci_upper", "p_positive")])
