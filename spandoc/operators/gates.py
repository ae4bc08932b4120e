"""Rule-based decisions over result tables: one row of checks and a verdict each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def qwk_row(results: DataFrame, names: dict[str, str], column: str = "qwk") -> DataFrame:
    """One row with the value of each named condition (NULL if absent)."""
    return results.agg(*[F.max(F.when(F.col("condition") == c, F.col(column))).alias(n) for n, c in names.items()])


def _side_by_side(*rows: DataFrame) -> DataFrame:
    out = rows[0].withColumn("one", F.lit(1))
    for r in rows[1:]:
        out = out.join(r.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _count(*checks: str) -> Column:
    total = F.lit(0)
    for c in checks:
        total = total + F.col(c).cast("int")
    return total


def feasibility_gate(results: DataFrame, comparisons: DataFrame, threshold: float = 0.005,
                     group_share: float = 0.6) -> DataFrame:
    """GREEN / YELLOW / RED.  ``results`` has condition, base and qwk."""
    q = qwk_row(results, {"t3": "T3", "t2": "T2", "n2": "N2", "n1": "N1"})
    means = results.agg(*[F.avg(F.when(F.col("base") == b, F.col("qwk"))).alias(f"mean_{b.lower()}") for b in ("TS", "NS")])
    pair = comparisons.filter("condition_a = 'T3' AND condition_b = 'T2'").agg(
        F.max("bootstrap_ci_lower").alias("ci_lower"), F.max("groups_positive").alias("won"), F.max("groups_total").alias("of"))
    row = _side_by_side(q, means, pair).withColumns({
        "t3_beats_t2": _yes(F.col("t3") - F.col("t2") >= threshold),
        "t3_beats_shuffled": _yes(F.col("t3") - F.col("mean_ts") >= threshold),
        "ci_positive": _yes(F.col("ci_lower") > 0),
        "groups_consistent": _yes(F.try_divide(F.col("won"), F.col("of")) >= group_share),
        "trees_fail": _yes((F.col("n2") <= F.col("mean_ns")) | (F.col("n2") <= F.col("n1"))),
        "text_fails": _yes((F.col("t3") <= F.col("mean_ts")) | (F.col("t3") <= F.col("t2"))),
    })
    green = F.col("t3_beats_t2") & F.col("t3_beats_shuffled") & F.col("ci_positive") & F.col("groups_consistent")
    return row.withColumn("decision", F.when(green, "GREEN").when(F.col("trees_fail") & F.col("text_fails"), "RED").otherwise("YELLOW")).select(
        "t3_beats_t2", "t3_beats_shuffled", "ci_positive", "groups_consistent", "trees_fail", "text_fails", "decision")


def stress_gate(results: DataFrame, comparisons: DataFrame, best: DataFrame, threshold: float = 0.005,
                best_wanted: int = 9) -> DataFrame:
    """Strong / partial / not yet.  ``best`` has the best condition per held-out group."""
    q = qwk_row(results, {"t3": "T3", "t2": "T2"})
    means = results.agg(*[F.avg(F.when(F.col("base") == b, F.col("qwk"))).alias(f"mean_{b.lower()}") for b in ("RND", "RB")])
    pair = comparisons.filter("condition_a = 'T3' AND condition_b = 'T2'").agg(F.max("bootstrap_ci_lower").alias("ci_lower"))
    wins = best.agg(F.count_if(F.col("best_condition") == "T3").alias("t3_best_count"))
    row = _side_by_side(q, means, pair, wins).withColumns({
        "beats_random": _yes(F.col("t3") - F.col("mean_rnd") >= threshold),
        "beats_boundaries": _yes(F.col("t3") - F.col("mean_rb") >= threshold),
        "ci_positive": _yes(F.col("ci_lower") > 0),
        "best_often": F.col("t3_best_count") >= best_wanted,
    })
    strong = F.col("beats_random") & F.col("beats_boundaries") & F.col("ci_positive") & F.col("best_often")
    partial = _yes((F.col("t3") > F.col("t2")) & (F.col("t3") > F.col("mean_rnd")))
    return row.withColumn("decision", F.when(strong, "STRONG").when(partial, "PARTIAL").otherwise("NOT YET")).select(
        "beats_random", "beats_boundaries", "ci_positive", "best_often", "t3_best_count", "decision")


def verification_gate(results: DataFrame, residual_qwk: DataFrame, audit_ok: DataFrame) -> DataFrame:
    """PROCEED TO FINAL TESTING / PROCEED WITH REFRAMED CLAIM / STOP.

    ``residual_qwk``: one row (residual_t3); ``audit_ok``: one row (audit_ok).
    """
    q = qwk_row(results, {"t2": "T2", "t3": "T3", "pos_trans": "POS_TRANS", "shuffled": "REAL_BOUNDARY_SHUFFLED_LABEL"})
    row = _side_by_side(q, residual_qwk, audit_ok).withColumns({
        "residual_beats_t2": _yes(F.col("residual_t3") > F.col("t2") + 0.003),
        "t3_beats_shuffled": _yes(F.col("t3") - F.col("shuffled") > 0.005),
        "signal_left": _yes((F.col("pos_trans") > F.col("t2")) | (F.col("residual_t3") > F.col("t2"))),
    })
    return row.withColumn(
        "decision",
        F.when(F.col("residual_beats_t2") & F.col("t3_beats_shuffled"), "PROCEED TO FINAL TESTING")
        .when(F.col("audit_ok") & F.col("signal_left"), "PROCEED WITH REFRAMED CLAIM").otherwise("STOP"),
    ).select("residual_beats_t2", "t3_beats_shuffled", "signal_left", "audit_ok", "decision")


def _difference(table: DataFrame, wanted: dict[str, tuple[str, str]], column: str) -> DataFrame:
    return table.agg(*[
        F.max(F.when((F.col("condition_a") == a) & (F.col("condition_b") == b), F.col(column))).alias(n)
        for n, (a, b) in wanted.items()])


def claim_gate(results: DataFrame, comparisons: DataFrame, group_metrics: DataFrame, subgroup_metrics: DataFrame,
               threshold: float = 0.003, group_share: float = 0.6) -> DataFrame:
    """CLAIM SUPPORTED / PARTIALLY SUPPORTED / NOT SUPPORTED: five core, three supportive checks."""
    full, base = "T3_PLUS_POS", "T2"
    core = {
        "beats_text_counts": (full, base), "pos_beats_t2": ("POS", base), "beats_mean_ts": (full, "mean_TS"),
        "beats_mean_rb": (full, "mean_RB"), "beats_mean_rnd": (full, "mean_RND"),
    }
    diffs = _difference(comparisons, core, "qwk_diff")
    q = qwk_row(results, {"pos_trans": "POS_TRANS", "pos": "POS"})

    def wins(table: DataFrame, level: str, name: str) -> DataFrame:
        per = table.groupBy(level).agg(
            F.max(F.when(F.col("condition") == full, F.col("qwk"))).alias("x"),
            F.max(F.when(F.col("condition") == base, F.col("qwk"))).alias("y"))
        return per.agg(F.count_if(F.col("x") > F.col("y")).alias(f"{name}_won"),
                       F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias(f"{name}_valid"),
                       F.count(F.lit(1)).alias(f"{name}_all"))

    row = _side_by_side(diffs, q, wins(group_metrics, "grp", "g"), wins(subgroup_metrics.filter("subgrp <> 'ALL'"), "subgrp", "s"))
    row = row.withColumns({
        **{n: _yes(F.col(n) >= threshold) for n in core},
        "trans_beats_pos": _yes(F.col("pos_trans") - F.col("pos") >= 0),
        "group_consistency": _yes(F.try_divide(F.col("g_won"), F.col("g_valid")) >= group_share),
        "subgroup_consistency": (F.col("s_all") > 0) & (F.col("s_won") >= F.floor(F.col("s_all") / 2) + 1),
    })
    n_core, n_support = _count(*core), _count("trans_beats_pos", "group_consistency", "subgroup_consistency")
    verdict = (
        F.when((n_core == len(core)) & (n_support >= 2), "CLAIM SUPPORTED")
        .when((n_core >= 3) & F.col("beats_text_counts"), "CLAIM PARTIALLY SUPPORTED").otherwise("CLAIM NOT SUPPORTED"))
    return row.withColumn("decision", verdict).select(
        *core, "trans_beats_pos", "group_consistency", "subgroup_consistency", "decision")


def robustness_gate(comparisons: DataFrame, group_means: DataFrame, n_seeds: int, threshold: float = 0.003,
                    group_share: float = 0.6, frozen: bool = True) -> DataFrame:
    """Robustness SUPPORTED / PARTIALLY SUPPORTED / NOT SUPPORTED for the embedding conditions.

    ``comparisons``: condition_a, condition_b, qwk_diff_mean; ``group_means``: condition, grp,
    qwk_mean.  One seed, or frozen vectors, never give more than PARTIALLY.
    """
    core = {
        "beats_text": ("D_STRUCT", "D0"), "beats_counts": ("D_STRUCT", "D2"), "beats_shuffled": ("D_STRUCT", "D_SHUFFLED"),
        "beats_random": ("D_STRUCT", "D_RANDOM"), "pos_beats_counts": ("D_POS", "D2"),
    }
    per = group_means.groupBy("grp").agg(
        F.max(F.when(F.col("condition") == "D_STRUCT", F.col("qwk_mean"))).alias("x"),
        F.max(F.when(F.col("condition") == "D2", F.col("qwk_mean"))).alias("y"))
    groups = per.agg(F.avg(F.when(F.col("x") > F.col("y"), 1.0).otherwise(0.0)).alias("group_fraction"))
    row = _side_by_side(_difference(comparisons, core, "qwk_diff_mean"), groups).withColumns(
        {n: _yes(F.col(n) >= threshold) for n in core})
    n_core = _count(*core)
    some, none = "ROBUSTNESS PARTIALLY SUPPORTED", "ROBUSTNESS NOT SUPPORTED"
    if n_seeds == 1:
        verdict = F.when(n_core >= 2, some).otherwise(none)
    else:
        best = some if frozen else "ROBUSTNESS SUPPORTED"
        verdict = (
            F.when((n_core == len(core)) & (F.coalesce(F.col("group_fraction"), F.lit(0.0)) >= group_share), best)
            .when((n_core >= 3) & F.col("beats_counts"), some).otherwise(none))
    return row.withColumn("decision", verdict).select(*core, "group_fraction", "decision")
