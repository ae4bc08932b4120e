"""Comparison rows: metric differences, groups won and bootstrap interval in one line."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spandoc.operators import bootstrap as boot, metrics as m


def _named(overall: DataFrame, suffix: str) -> DataFrame:
    return overall.select(F.col("condition").alias(f"condition_{suffix}"), *[
        F.col(c).alias(f"{c}_{suffix}") for c in ("qwk", "rmse", "mae")])


def compare_pairs(preds: DataFrame, pairs: list[tuple[str, str]], replicates: int = 10000, seed: int = 42,
                  method: str = "multinomial") -> DataFrame:
    """One row per pair of conditions."""
    spark = preds.sparkSession
    cells = m.score_cells(preds, ["condition", "grp"])
    overall = m.metrics_from_cells(m.regroup(cells, ["condition"]), ["condition"])
    won = m.groups_won(m.kappa(cells, ["condition", "grp"], guard=True), m.pair_table(spark, pairs))
    rows = won.join(_named(overall, "a"), "condition_a").join(_named(overall, "b"), "condition_b")
    intervals = None
    for a, b in pairs:
        one = boot.paired_bootstrap(preds, a, b, replicates, seed, method).select(
            F.lit(a).alias("condition_a"), F.lit(b).alias("condition_b"),
            F.col("qwk_diff_mean").alias("bootstrap_qwk_diff_mean"), F.col("ci_lower").alias("bootstrap_ci_lower"),
            F.col("ci_upper").alias("bootstrap_ci_upper"), F.col("p_positive").alias("bootstrap_p_positive"))
        intervals = one if intervals is None else intervals.unionByName(one)
    return rows.join(intervals, ["condition_a", "condition_b"]).select(
        F.concat_ws("_vs_", "condition_a", "condition_b").alias("comparison"), "condition_a", "condition_b",
        "qwk_a", "qwk_b", (F.col("qwk_a") - F.col("qwk_b")).alias("qwk_diff"),
        (F.col("rmse_a") - F.col("rmse_b")).alias("rmse_diff"), (F.col("mae_a") - F.col("mae_b")).alias("mae_diff"),
        "groups_positive", "groups_total", "bootstrap_qwk_diff_mean", "bootstrap_ci_lower", "bootstrap_ci_upper",
        "bootstrap_p_positive")


def compare_vs_mean(preds: DataFrame, a: str, bases: list[str], replicates: int = 10000, seed: int = 42,
                    method: str = "multinomial") -> DataFrame:
    """``a`` against the mean over the seeds of each control base."""
    spark = preds.sparkSession
    seeded = preds.filter(F.col("base").isin(*bases) & F.col("seed").isNotNull())
    single = preds.filter(F.col("condition") == a)
    one = m.metrics(single).select(*[F.col(c).alias(f"{c}_a") for c in ("qwk", "rmse", "mae")], F.lit(1).alias("one"))
    by_seed = m.metrics(seeded, ["base", "condition"])
    mean = by_seed.groupBy("base").agg(
        *[F.avg(c).alias(f"{c}_b") for c in ("qwk", "rmse", "mae")],
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(
            F.struct(F.col("condition").alias("k"), F.round("qwk", 9).alias("v")))))).alias("control_seed_qwks_json"))
    joint = m.metrics(m.averaged_predictions(seeded), ["base"]).select("base", F.col("qwk").alias("qwk_b_ensemble"))
    groups = m.mean_over_seeds(
        m.group_kappa(seeded, ["base", "condition", "grp"]).filter("qwk IS NOT NULL"), ["grp"]).unionByName(
        m.group_kappa(single).select("grp", "qwk", "condition"))
    won = m.groups_won(groups, m.pair_table(spark, [(a, f"mean_{b}") for b in bases])).withColumn(
        "base", F.replace("condition_b", F.lit("mean_")))
    intervals = None
    names = {b: sorted(r[0] for r in seeded.filter(F.col("base") == b).select("condition").distinct().collect()) for b in bases}
    for b in bases:
        ci = boot.bootstrap_vs_mean(preds, a, names[b], replicates, seed, method).select(
            F.lit(b).alias("base"), F.col("qwk_diff_mean").alias("bootstrap_qwk_diff_mean"),
            F.col("ci_lower").alias("bootstrap_ci_lower"), F.col("ci_upper").alias("bootstrap_ci_upper"),
            F.col("p_positive").alias("bootstrap_p_positive"))
        intervals = ci if intervals is None else intervals.unionByName(ci)
    rows = mean.withColumn("one", F.lit(1)).join(F.broadcast(one), "one").drop("one")
    return rows.join(joint, "base").join(won, "base").join(intervals, "base").select(
        F.concat_ws("_vs_", "condition_a", "condition_b").alias("comparison"), "condition_a", "condition_b",
        "qwk_a", "qwk_b", "qwk_b_ensemble", (F.col("qwk_a") - F.col("qwk_b")).alias("qwk_diff"),
        (F.col("qwk_a") - F.col("qwk_b_ensemble")).alias("qwk_diff_ensemble"),
        (F.col("rmse_a") - F.col("rmse_b")).alias("rmse_diff"), (F.col("mae_a") - F.col("mae_b")).alias("mae_diff"),
        "groups_positive", "groups_total", "control_seed_qwks_json", "bootstrap_qwk_diff_mean",
        "bootstrap_ci_lower", "bootstrap_ci_upper", "bootstrap_p_positive")


def compare_seeded(preds: DataFrame, pairs: list[tuple[str, str]], replicates: int = 10000, seed: int = 42,
                   method: str = "multinomial") -> DataFrame:
    """Base conditions compared seed by seed; the interval is on seed-averaged predictions.

    The mean of the seed differences and the bootstrap mean have different names: they are
    different quantities.
    """
    spark = preds.sparkSession
    seeded = preds.filter(F.col("seed").isNotNull())
    q = m.metrics(seeded, ["base", "seed"]).select("base", "seed", "qwk")
    a = q.select(F.col("base").alias("condition_a"), "seed", F.col("qwk").alias("qa"))
    b = q.select(F.col("base").alias("condition_b"), "seed", F.col("qwk").alias("qb"))
    met = m.pair_table(spark, pairs).join(a, "condition_a").join(b, ["condition_b", "seed"])
    diffs = met.groupBy("condition_a", "condition_b").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg("qa").alias("qwk_a_mean"), F.avg("qb").alias("qwk_b_mean"),
        F.avg(F.col("qa") - F.col("qb")).alias("qwk_diff_mean"),
        F.stddev_pop(F.col("qa") - F.col("qb")).alias("qwk_diff_std"))
    avg = m.averaged_predictions(seeded).withColumn("condition", F.col("base"))
    won = m.groups_won(m.group_kappa(avg), m.pair_table(spark, pairs))
    intervals = None
    for x, y in pairs:
        ci = boot.paired_bootstrap(avg, x, y, replicates, seed, method).select(
            F.lit(x).alias("condition_a"), F.lit(y).alias("condition_b"),
            F.col("qwk_diff_mean").alias("bootstrap_qwk_diff_mean"), "ci_lower", "ci_upper", "p_positive")
        intervals = ci if intervals is None else intervals.unionByName(ci)
    return diffs.join(won, ["condition_a", "condition_b"]).join(intervals, ["condition_a", "condition_b"]).withColumn(
        "comparison", F.concat_ws("_vs_", "condition_a", "condition_b"))
