"""Agreement and error metrics from long prediction tables.

Predictions: (condition, entity_id, y_true, y_pred [, seed, base, grp, subgrp]).  Every metric
is a fold over cells (keys, true, rounded prediction): at most 36 per key, so partial
aggregation does nearly all the work and a condition with all rows is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spandoc.functions.scalar import clip, clip_and_round
from spandoc.schemas import SCORE_MAX, SCORE_MIN

METRICS = ("qwk", "rmse", "mae", "exact_accuracy", "adjacent_accuracy")


def score_cells(preds: DataFrame, keys: list[str], lo: int = SCORE_MIN, hi: int = SCORE_MAX) -> DataFrame:
    """(keys, t, p, n, se, ae): counts and error sums per true / rounded predicted score."""
    err = F.col("y_true") - clip(F.col("y_pred"), lo, hi)
    return (
        preds.select(
            *keys, F.rint("y_true").cast("bigint").alias("t"),
            clip_and_round(F.col("y_pred"), lo, hi).alias("p"), err.cast("double").alias("e"))
        .groupBy(*keys, "t", "p")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") * F.col("e")).alias("se"), F.sum(F.abs("e")).alias("ae"))
    )


def regroup(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Coarser cells from finer ones."""
    sums = [c for c in ("n", "se", "ae") if c in cells.columns]
    return cells.groupBy(*keys, "t", "p").agg(*[F.sum(c).alias(c) for c in sums])


def kappa_columns(cells: DataFrame, keys: list[str], labels: str = "present") -> DataFrame:
    """Cells with the label positions used as weights.

    ``present``: position among the labels that occur (as true or predicted) under the key,
    so an unused score between two used ones does not widen their distance.  ``value``: the
    score itself.  Labels are integers of any size.
    """
    if labels == "value":
        return cells.withColumns({"i": F.col("t"), "j": F.col("p")})
    if labels != "present":
        raise ValueError(f"unknown labels mode {labels!r}")
    by_key = Window.partitionBy(*keys)
    used = F.flatten(F.collect_set(F.array("t", "p")).over(by_key))
    place = F.array_sort(F.array_distinct(used))
    return cells.withColumn("used", place).withColumns(
        {"i": F.array_position("used", F.col("t")) - 1, "j": F.array_position("used", F.col("p")) - 1}).drop("used")


def _kappa_from_sums() -> Column:
    """1 - n*sum (i-j)^2 / (n*(sum i^2 + sum j^2) - 2*sum i*sum j): all sums are integers."""
    n = F.col("n_rows").cast("double")
    num = n * F.col("s_dd").cast("double")
    den = n * (F.col("s_ii") + F.col("s_jj")).cast("double") - F.lit(2.0) * F.col("s_i").cast("double") * F.col("s_j").cast("double")
    return F.when(den != 0, F.lit(1.0) - num / den)


def _moment_sums() -> list[Column]:
    n, i, j = F.col("n"), F.col("i"), F.col("j")
    return [
        F.sum("n").alias("n_rows"), F.sum(n * i).alias("s_i"), F.sum(n * j).alias("s_j"),
        F.sum(n * i * i).alias("s_ii"), F.sum(n * j * j).alias("s_jj"),
        F.sum(n * (i - j) * (i - j)).alias("s_dd"), F.size(F.collect_set("t")).alias("true_labels"),
    ]


def kappa(cells: DataFrame, keys: list[str], labels: str = "present", guard: bool = False) -> DataFrame:
    """(keys, n, qwk).  ``guard``: NULL for fewer than two rows or a single true label."""
    sums = kappa_columns(cells, keys, labels).groupBy(*keys).agg(*_moment_sums())
    q = _kappa_from_sums()
    if guard:
        q = F.when((F.col("n_rows") >= 2) & (F.col("true_labels") >= 2), q)
    return sums.select(*keys, F.col("n_rows").alias("n"), q.alias("qwk"))


def metrics_from_cells(cells: DataFrame, keys: list[str], labels: str = "present") -> DataFrame:
    """(keys, n, qwk, rmse, mae, exact_accuracy, adjacent_accuracy)."""
    off = F.abs(F.col("t") - F.col("p"))
    sums = kappa_columns(cells, keys, labels).groupBy(*keys).agg(
        *_moment_sums(), F.sum("se").alias("se"), F.sum("ae").alias("ae"),
        F.sum(F.when(off == 0, F.col("n")).otherwise(0)).alias("exact"),
        F.sum(F.when(off <= 1, F.col("n")).otherwise(0)).alias("adjacent"),
    )
    n = F.col("n_rows")
    return sums.select(
        *keys, n.alias("n"), _kappa_from_sums().alias("qwk"), F.sqrt(F.col("se") / n).alias("rmse"),
        (F.col("ae") / n).alias("mae"), (F.col("exact") / n).alias("exact_accuracy"),
        (F.col("adjacent") / n).alias("adjacent_accuracy"))


def metrics(preds: DataFrame, keys: list[str] | None = None, labels: str = "present") -> DataFrame:
    keys = ["condition"] if keys is None else keys
    return metrics_from_cells(score_cells(preds, keys), keys, labels)


def group_kappa(preds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """QWK per (condition, group), NULL where it is undefined."""
    keys = ["condition", "grp"] if keys is None else keys
    return kappa(score_cells(preds, keys), keys, guard=True)


def metrics_with_total(preds: DataFrame, level: str = "subgrp", total: str = "ALL") -> DataFrame:
    """Metrics per (condition, level) and for all levels together, from one pass of cells."""
    cells = score_cells(preds, ["condition", level])
    both = cells.withColumn(level, F.explode(F.array(F.col(level), F.lit(total))))
    keys = ["condition", level]
    return metrics_from_cells(regroup(both, keys), keys)


def confusion(preds: DataFrame, lo: int = SCORE_MIN, hi: int = SCORE_MAX) -> DataFrame:
    """Dense true x predicted grid per condition (zeros kept) with row totals."""
    cells = score_cells(preds, ["condition"], lo, hi).select("condition", "t", "p", "n")
    scores = F.sequence(F.lit(lo).cast("bigint"), F.lit(hi).cast("bigint"))
    grid = (
        cells.select("condition").distinct()
        .select("condition", F.explode(scores).alias("t")).select("condition", "t", F.explode(scores).alias("p"))
    )
    counted = grid.join(cells, ["condition", "t", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("condition", "t"))
    return counted.select("condition", F.col("t").alias("true_score"), F.col("p").alias("predicted_score"),
                          F.col("n").alias("count"), total.alias("row_total"))


def pair_table(spark, pairs: list[tuple[str, str]]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(pairs, "condition_a string, condition_b string"))


def groups_won(group_metrics: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair: groups where a beats b, and groups where both are defined."""
    a = group_metrics.select(F.col("condition").alias("condition_a"), "grp", F.col("qwk").alias("qa"))
    b = group_metrics.select(F.col("condition").alias("condition_b"), "grp", F.col("qwk").alias("qb"))
    met = pairs.join(a, "condition_a").join(b, ["condition_b", "grp"]).filter("qa IS NOT NULL AND qb IS NOT NULL")
    return met.groupBy("condition_a", "condition_b").agg(
        F.count_if(F.col("qa") > F.col("qb")).alias("groups_positive"), F.count(F.lit(1)).alias("groups_total"))


def mean_over_seeds(group_metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Average seed-level QWK: (``mean_<base>``, keys, qwk)."""
    return group_metrics.groupBy("base", *keys).agg(F.avg("qwk").alias("qwk")).withColumn(
        "condition", F.concat(F.lit("mean_"), "base")).drop("base")


def averaged_predictions(preds: DataFrame) -> DataFrame:
    """Mean prediction over the seeds of a base condition, per entity (``ensemble_<base>``)."""
    rest = [c for c in ("grp", "subgrp") if c in preds.columns]
    return preds.groupBy("base", "entity_id", "y_true", *rest).agg(F.avg("y_pred").alias("y_pred")).withColumn(
        "condition", F.concat(F.lit("ensemble_"), "base"))


def seed_aggregation(preds: DataFrame, reference: str) -> DataFrame:
    """Seed-level QWK, mean of seed-level QWK (primary) and QWK of the averaged prediction
    (secondary) of every control, each with its distance to ``reference``."""
    seeded = preds.filter(F.col("seed").isNotNull())
    by_seed = metrics(seeded, ["base", "condition", "seed"]).select("base", "condition", "seed", "qwk")
    level = by_seed.withColumn("aggregation", F.lit("seed_level"))
    mean = mean_over_seeds(by_seed, []).select(
        F.replace("condition", F.lit("mean_")).alias("base"), "condition", F.lit(None).cast("bigint").alias("seed"),
        "qwk", F.lit("mean_seed_qwk").alias("aggregation"))
    both = metrics(averaged_predictions(seeded), ["base", "condition"]).select(
        "base", "condition", F.lit(None).cast("bigint").alias("seed"), "qwk",
        F.lit("ensemble_prediction_qwk").alias("aggregation"))
    ref = metrics(preds.filter(F.col("condition") == reference)).select(F.col("qwk").alias("ref"), F.lit(1).alias("one"))
    rows = level.unionByName(mean).unionByName(both).withColumn("one", F.lit(1))
    return rows.join(F.broadcast(ref), "one").select(
        F.col("base").alias("control"), "condition", "seed", "aggregation", "qwk",
        (F.col("ref") - F.col("qwk")).alias("reference_minus_qwk"))


def seed_summary(preds: DataFrame) -> DataFrame:
    """Mean and sample deviation of seed-level metrics per base condition."""
    by_seed = metrics(preds.filter(F.col("seed").isNotNull()), ["base", "seed"])
    return by_seed.groupBy("base").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg("qwk").alias("qwk_mean"), F.stddev_samp("qwk").alias("qwk_std"),
        *[F.avg(m).alias(f"{m}_mean") for m in METRICS[1:]])


def seed_summary_by(preds: DataFrame, level: str) -> DataFrame:
    """Mean seed-level QWK per base condition and level."""
    by_seed = group_kappa(preds.filter(F.col("seed").isNotNull()), ["base", "seed", level])
    return by_seed.groupBy("base", level).agg(F.avg("qwk").alias("qwk_mean"))


def best_condition(scores: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Condition with the highest QWK per key; ties go to the earlier name in ``order``."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("condition"))
    ranked = scores.filter(F.col("condition").isin(*order) & F.col("qwk").isNotNull())
    return ranked.groupBy(key).agg(
        F.max_by("condition", F.struct("qwk", -place)).alias("best_condition"), F.max("qwk").alias("best_qwk"))


def direction_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Do two comparison tables (name, qwk_diff) point the same way?"""
    a = first.select("comparison", F.col("qwk_diff").alias("diff_a"))
    b = second.select("comparison", F.col("qwk_diff").alias("diff_b"))
    return a.join(b, "comparison").withColumn("same_direction", (F.col("diff_a") > 0) == (F.col("diff_b") > 0))
