"""Prediction metrics, group metrics and seed aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spandoc.catalog import metric_sql as ms
from spandoc.catalog.ctes import sql
from spandoc.catalog.registry import query
from spandoc.operators import metrics as m, qa
from spandoc.sources import adapters as src

PAIRS = [("T3_PLUS_POS", "T2"), ("T3_PLUS_POS", "T3"), ("POS", "T2"), ("POS_TRANS", "T2"), ("T3", "T2")]
PAIR_SQL = "pairs(condition_a, condition_b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ")"


def rounded(df, digits: int = 9):
    """Round every double column (both engines agree to far more digits than these)."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("clip_and_round", sql("SELECT condition, entity_id, y_round FROM rounded", "rounded"))
def clip_rounding(spark, sf):
    from spandoc.functions.scalar import clip_and_round

    return src.predictions(spark, sf).select("condition", "entity_id", clip_and_round(F.col("y_pred")).alias("y_round"))


@query("metrics_overall", sql(f"SELECT condition, n, {ms.ROUNDED} FROM k", "rounded",
                              extra=ms.cells("c0", "rounded", ["condition"]) + ",\n" + ms.full("k", "c0", ["condition"])))
def metrics_overall(spark, sf):
    return rounded(m.metrics(src.predictions(spark, sf)))


@query("metrics_by_group", sql("SELECT condition, grp, n, round(qwk, 9) AS qwk FROM k", "rounded",
                               extra=ms.cells("c0", "rounded", ["condition", "grp"]) + ",\n" + ms.kappa("k", "c0", ["condition", "grp"], True)))
def metrics_by_group(spark, sf):
    return rounded(m.group_kappa(src.predictions(spark, sf)))


@query("metrics_rollup", sql(f"SELECT condition, subgrp, n, {ms.ROUNDED} FROM k UNION ALL SELECT condition, 'ALL', n, {ms.ROUNDED} FROM a",
                             "rounded", extra=",\n".join([
                                 ms.cells("c0", "rounded", ["condition", "subgrp"]), ms.full("k", "c0", ["condition", "subgrp"]),
                                 ms.cells("c1", "rounded", ["condition"]), ms.full("a", "c1", ["condition"])])))
def metrics_rollup(spark, sf):
    return rounded(m.metrics_with_total(src.predictions(spark, sf)))


@query("kappa_value_weights", sql("""SELECT condition, count(*) AS n, round(1 - avg((y_true - y_round) ** 2) /
  (var_pop(y_true) + var_pop(y_round) + (avg(y_true) - avg(y_round)) ** 2), 9) AS qwk FROM rounded GROUP BY condition""", "rounded"))
def kappa_value_weights(spark, sf):
    return rounded(m.kappa(m.score_cells(src.predictions(spark, sf), ["condition"]), ["condition"], labels="value"))


@query("kappa_present_labels", sql("SELECT grp, n, round(qwk, 9) AS qwk FROM k", "rounded", extra="""holed AS (
  SELECT grp, y_true, CASE WHEN y_round = 3 THEN 4 ELSE y_round END AS y_round, y_clip FROM rounded WHERE y_true <> 3 AND condition = 'T2'),
""" + ms.cells("c0", "holed", ["grp"]) + ",\n" + ms.kappa("k", "c0", ["grp"])))
def kappa_present_labels(spark, sf):
    """Scores with a hole at 3: label positions, not values, are the weights."""
    cells = m.score_cells(src.predictions(spark, sf).filter("condition = 'T2' AND y_true <> 3"), ["grp"])
    holed = m.regroup(cells.withColumn("p", F.when(F.col("p") == 3, 4).otherwise(F.col("p"))), ["grp"])
    return rounded(m.kappa(holed, ["grp"]))


@query("confusion", sql("""SELECT g.condition, t.v AS true_score, p.v AS predicted_score,
    (SELECT count(*) FROM rounded r WHERE r.condition = g.condition AND r.y_true = t.v AND r.y_round = p.v) AS count,
    (SELECT count(*) FROM rounded r WHERE r.condition = g.condition AND r.y_true = t.v) AS row_total
  FROM (SELECT DISTINCT condition FROM rounded) g, (SELECT unnest(range(1, 7)) AS v) t, (SELECT unnest(range(1, 7)) AS v) p""", "rounded"))
def confusion(spark, sf):
    return m.confusion(src.predictions(spark, sf))


_GROUPS = ms.cells("c0", "rounded", ["condition", "grp"]) + ",\n" + ms.kappa("k", "c0", ["condition", "grp"], True)


@query("groups_won", sql("""SELECT condition_a, condition_b, count(*) FILTER (a.qwk > b.qwk) AS groups_positive, count(*) AS groups_total
  FROM pairs JOIN k a ON a.condition = condition_a JOIN k b ON b.condition = condition_b AND a.grp = b.grp
  WHERE a.qwk IS NOT NULL AND b.qwk IS NOT NULL GROUP BY ALL""", "rounded", extra=_GROUPS + ",\n" + PAIR_SQL))
def groups_won(spark, sf):
    return m.groups_won(m.group_kappa(src.predictions(spark, sf)), m.pair_table(spark, PAIRS))


@query("groups_won_vs_mean", sql("""SELECT 'T3_PLUS_POS' AS condition_a, 'mean_' || base AS condition_b,
    count(*) FILTER (a.qwk > b.qwk) AS groups_positive, count(*) AS groups_total
  FROM k a JOIN (SELECT base, grp, avg(qwk) AS qwk FROM k JOIN conds USING (condition) WHERE seed IS NOT NULL GROUP BY base, grp) b USING (grp)
  WHERE a.condition = 'T3_PLUS_POS' GROUP BY base""", "rounded", extra=_GROUPS))
def groups_won_vs_mean(spark, sf):
    preds = src.predictions(spark, sf)
    per = m.group_kappa(preds, ["base", "condition", "seed", "grp"])
    mean = m.mean_over_seeds(per.filter("seed IS NOT NULL"), ["grp"])
    both = mean.unionByName(per.filter("condition = 'T3_PLUS_POS'").select("condition", "grp", "qwk"))
    pairs = m.pair_table(spark, [("T3_PLUS_POS", f"mean_{b}") for b in src.CONTROL_CONDITIONS])
    return m.groups_won(both, pairs)


_ENSEMBLE = """ens AS (SELECT base, grp, y_true, least(greatest(yp, 1e0), 6e0) AS y_clip,
    CAST(round_even(least(greatest(yp, 1e0), 6e0), 0) AS BIGINT) AS y_round
  FROM (SELECT base, entity_id, any_value(grp) AS grp, any_value(y_true) AS y_true, avg(y_pred) AS yp FROM preds WHERE seed IS NOT NULL GROUP BY base, entity_id))"""
_BY_COND = ms.cells("c1", "rounded", ["condition"]) + ",\n" + ms.full("kc", "c1", ["condition"])


@query("seed_aggregation", sql("""SELECT *, round((SELECT qwk FROM kc WHERE condition = 'T3_PLUS_POS') - q, 9) AS reference_minus_qwk
  FROM (SELECT *, round(q, 9) AS qwk FROM (
    SELECT base AS control, kc.condition, seed, 'seed_level' AS aggregation, qwk AS q FROM kc JOIN conds USING (condition) WHERE seed IS NOT NULL
    UNION ALL SELECT base, 'mean_' || base, NULL, 'mean_seed_qwk', avg(qwk) FROM kc JOIN conds USING (condition) WHERE seed IS NOT NULL GROUP BY base
    UNION ALL SELECT base, 'ensemble_' || base, NULL, 'ensemble_prediction_qwk', qwk FROM ke))""".replace("SELECT *, round((SELECT", "SELECT control, condition, seed, aggregation, qwk, round((SELECT"),
    "rounded", extra=_BY_COND + ",\n" + _ENSEMBLE + ",\n" + ms.cells("c2", "ens", ["base"]) + ",\n" + ms.kappa("ke", "c2", ["base"])))
def seed_aggregation(spark, sf):
    return rounded(m.seed_aggregation(src.predictions(spark, sf), "T3_PLUS_POS"))


@query("seed_summary", sql("""SELECT base, count(*) AS n_seeds, round(avg(qwk), 9) AS qwk_mean, round(stddev_samp(qwk), 9) AS qwk_std,
    round(avg(rmse), 9) AS rmse_mean, round(avg(mae), 9) AS mae_mean, round(avg(exact_accuracy), 9) AS exact_accuracy_mean,
    round(avg(adjacent_accuracy), 9) AS adjacent_accuracy_mean FROM kc JOIN conds USING (condition) WHERE seed IS NOT NULL GROUP BY base""",
  "rounded", extra=_BY_COND))
def seed_summary(spark, sf):
    return rounded(m.seed_summary(src.predictions(spark, sf)))


@query("seed_summary_by_group", sql("""SELECT base, grp, round(avg(qwk), 9) AS qwk_mean FROM k JOIN conds USING (condition)
  WHERE seed IS NOT NULL GROUP BY base, grp""", "rounded", extra=_GROUPS))
def seed_summary_by_group(spark, sf):
    return rounded(m.seed_summary_by(src.predictions(spark, sf), "grp"))


@query("seed_summary_by_subgroup", sql("""SELECT base, subgrp, round(avg(qwk), 9) AS qwk_mean FROM k JOIN conds USING (condition)
  WHERE seed IS NOT NULL GROUP BY base, subgrp""", "rounded",
  extra=ms.cells("c0", "rounded", ["condition", "subgrp"]) + ",\n" + ms.kappa("k", "c0", ["condition", "subgrp"], True)))
def seed_summary_by_subgroup(spark, sf):
    return rounded(m.seed_summary_by(src.predictions(spark, sf), "subgrp"))


@query("best_condition", sql("""SELECT grp, condition AS best_condition, round(qwk, 9) AS best_qwk FROM
  (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY qwk DESC, list_position(['T2','T3','POS','POS_TRANS'], condition)) AS rn
   FROM k WHERE condition IN ('T2','T3','POS','POS_TRANS')) WHERE rn = 1""", "rounded", extra=_GROUPS))
def best_condition(spark, sf):
    return rounded(m.best_condition(m.group_kappa(src.predictions(spark, sf)), "grp", ["T2", "T3", "POS", "POS_TRANS"]))


@query("direction_agreement", sql("""SELECT condition_a || '_vs_' || condition_b AS comparison, round(a.qwk - b.qwk, 9) AS diff_a,
    round(ga.q - gb.q, 9) AS diff_b, (a.qwk - b.qwk > 0) = (ga.q - gb.q > 0) AS same_direction
  FROM pairs JOIN kc a ON a.condition = condition_a JOIN kc b ON b.condition = condition_b
  JOIN (SELECT condition, avg(qwk) AS q FROM k GROUP BY 1) ga ON ga.condition = condition_a
  JOIN (SELECT condition, avg(qwk) AS q FROM k GROUP BY 1) gb ON gb.condition = condition_b""",
  "rounded", extra=_GROUPS + ",\n" + _BY_COND + ",\n" + PAIR_SQL))
def direction_agreement(spark, sf):
    """Does the overall difference point the same way as the mean difference over groups?"""
    preds = src.predictions(spark, sf)
    pairs = m.pair_table(spark, PAIRS)

    def diffs(scores):
        a = scores.select(F.col("condition").alias("condition_a"), F.col("qwk").alias("qa"))
        b = scores.select(F.col("condition").alias("condition_b"), F.col("qwk").alias("qb"))
        return pairs.join(a, "condition_a").join(b, "condition_b").select(
            F.concat_ws("_vs_", "condition_a", "condition_b").alias("comparison"), (F.col("qa") - F.col("qb")).alias("qwk_diff"))

    by_group = m.group_kappa(preds).groupBy("condition").agg(F.avg("qwk").alias("qwk"))
    return rounded(m.direction_agreement(diffs(m.metrics(preds)), diffs(by_group)))


@query("headline_check", sql("""SELECT condition, round(qwk, 4) AS qwk, w AS expected, round(qwk, 4) = w AS passed
  FROM kc JOIN (VALUES ('T3_PLUS_POS', 0.8488e0), ('T2', 0.8361e0)) v(condition, w) USING (condition)""", "rounded", extra=_BY_COND))
def headline_check(spark, sf):
    # Published test QWK of the two headline conditions.
    return qa.headline_check(m.metrics(src.predictions(spark, sf)), {"T3_PLUS_POS": 0.8488, "T2": 0.8361})
