"""Bootstrap intervals, comparison rows, gates and protocol checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from spandoc.catalog import metric_sql as ms
from spandoc.catalog.ctes import sql
from spandoc.catalog.evaluation import PAIR_SQL, PAIRS, _BY_COND, _ENSEMBLE, _GROUPS, rounded
from spandoc.catalog.registry import query
from spandoc.operators import bootstrap as boot, compare, gates, metrics as m
from spandoc.schemas import CONTROL_SEEDS
from spandoc.sources import adapters as src

REPS = 20
TS = [f"TS_s{s}" for s in CONTROL_SEEDS]
EXTRA_SEED = 13 ^ 99991


@query("bootstrap_pair", sql(ms.summary("d"), "rounded", extra=ms.bootstrap("d", ["T3_PLUS_POS", "T2"], REPS, [42])))
def bootstrap_pair(spark, sf):
    return rounded(boot.paired_bootstrap(src.predictions(spark, sf), "T3_PLUS_POS", "T2", REPS, 42, "keyed"))


@query("bootstrap_multi_seed", sql(
    f"SELECT *, CASE WHEN seed = {EXTRA_SEED} THEN 'extra' ELSE 'listed' END AS kind FROM ({ms.summary('d')})", "rounded",
    extra=ms.bootstrap("d", ["T3", "T2"], 10, [13, 21, EXTRA_SEED])))
def bootstrap_multi_seed(spark, sf):
    return rounded(boot.bootstrap_seeds(src.predictions(spark, sf), "T3", "T2", [13, 21], 10, "keyed"))


@query("bootstrap_multi_seed_mean", sql(
    "SELECT " + ", ".join(f"round(avg({c}), 8) AS bootstrap_{c}_mean" for c in ("qwk_diff_mean", "ci_lower", "ci_upper", "p_positive"))
    + f" FROM ({ms.summary('d', 15)})", "rounded", extra=ms.bootstrap("d", ["T3", "T2"], 10, [13, 21, EXTRA_SEED])))
def bootstrap_multi_seed_mean(spark, sf):
    return rounded(boot.seed_mean(boot.bootstrap_seeds(src.predictions(spark, sf), "T3", "T2", [13, 21], 10, "keyed")), 8)


@query("bootstrap_mean_control", sql(ms.summary("d"), "rounded", extra=ms.bootstrap("d", ["T3_PLUS_POS", *TS], 10, [42])))
def bootstrap_mean_control(spark, sf):
    return rounded(boot.bootstrap_vs_mean(src.predictions(spark, sf), "T3_PLUS_POS", TS, 10, 42, "keyed"))


@query("bootstrap_multinomial")
def bootstrap_multinomial(spark, sf):
    """The production draw: 10,000 replicates, cost independent of the number of rows."""
    return boot.paired_bootstrap(src.predictions(spark, sf), "T3_PLUS_POS", "T2", 10000, 42)


def _pair_ci(a: str, b: str, i: int) -> str:
    return ms.bootstrap(f"d{i}", [a, b], REPS, [42])


_CMP = [("T3_PLUS_POS", "T2"), ("T3", "T2")]
_CMP_EXTRA = ",\n".join([_GROUPS, _BY_COND, *[_pair_ci(a, b, i) for i, (a, b) in enumerate(_CMP)],
                         "ci AS (" + " UNION ALL ".join(
                             f"SELECT '{a}' AS condition_a, '{b}' AS condition_b, * FROM ({ms.summary(f'd{i}')})" for i, (a, b) in enumerate(_CMP)) + ")",
                         """cmp AS (SELECT condition_a || '_vs_' || condition_b AS comparison, condition_a, condition_b, round(a.qwk, 9) AS qwk_a, round(b.qwk, 9) AS qwk_b,
    round(a.qwk - b.qwk, 9) AS qwk_diff, round(a.rmse - b.rmse, 9) AS rmse_diff, round(a.mae - b.mae, 9) AS mae_diff,
    (SELECT count(*) FROM k x JOIN k y USING (grp) WHERE x.condition = condition_a AND y.condition = condition_b AND x.qwk > y.qwk) AS groups_positive,
    (SELECT count(*) FROM k x JOIN k y USING (grp) WHERE x.condition = condition_a AND y.condition = condition_b AND x.qwk IS NOT NULL AND y.qwk IS NOT NULL) AS groups_total,
    qwk_diff_mean AS bootstrap_qwk_diff_mean, ci_lower AS bootstrap_ci_lower, ci_upper AS bootstrap_ci_upper, p_positive AS bootstrap_p_positive
  FROM ci JOIN kc a ON a.condition = condition_a JOIN kc b ON b.condition = condition_b)"""])


@query("comparison_rows", sql("SELECT * FROM cmp", "rounded", extra=_CMP_EXTRA))
def comparison_rows(spark, sf):
    return rounded(compare.compare_pairs(src.predictions(spark, sf), _CMP, REPS, 42, "keyed"))


@query("comparison_vs_mean", sql("""SELECT 'T3_PLUS_POS_vs_mean_TS' AS comparison, 'T3_PLUS_POS' AS condition_a, 'mean_TS' AS condition_b,
    round(a.qwk, 9) AS qwk_a, round(b.q, 9) AS qwk_b, round(e.qwk, 9) AS qwk_b_ensemble, round(a.qwk - b.q, 9) AS qwk_diff,
    round(a.qwk - e.qwk, 9) AS qwk_diff_ensemble, round(a.rmse - b.r, 9) AS rmse_diff, round(a.mae - b.m, 9) AS mae_diff,
    (SELECT count(*) FROM k x JOIN gm USING (grp) WHERE x.condition = 'T3_PLUS_POS' AND x.qwk > gm.q) AS groups_positive,
    (SELECT count(*) FROM k x JOIN gm USING (grp) WHERE x.condition = 'T3_PLUS_POS' AND x.qwk IS NOT NULL) AS groups_total,
    qwk_diff_mean AS bootstrap_qwk_diff_mean, ci_lower AS bootstrap_ci_lower, ci_upper AS bootstrap_ci_upper, p_positive AS bootstrap_p_positive
  FROM (SELECT * FROM kc WHERE condition = 'T3_PLUS_POS') a,
    (SELECT avg(qwk) AS q, avg(rmse) AS r, avg(mae) AS m FROM kc JOIN conds USING (condition) WHERE base = 'TS') b,
    (SELECT * FROM ke WHERE base = 'TS') e, (""" + ms.summary("d") + ")", "rounded", extra=",\n".join([
        _GROUPS, _BY_COND, _ENSEMBLE, ms.cells("c2", "ens", ["base"]), ms.kappa("ke", "c2", ["base"]),
        "gm AS (SELECT grp, avg(qwk) AS q FROM k JOIN conds USING (condition) WHERE base = 'TS' GROUP BY grp)",
        ms.bootstrap("d", ["T3_PLUS_POS", *sorted(TS)], 10, [42])])))
def comparison_vs_mean(spark, sf):
    out = compare.compare_vs_mean(src.predictions(spark, sf), "T3_PLUS_POS", ["TS"], 10, 42, "keyed")
    return rounded(out.drop("control_seed_qwks_json"))


_ENS_ROUNDED = "er AS (SELECT base AS condition, base, entity_id, grp, y_true, y_clip, y_round FROM ens0)"
_ENS0 = _ENSEMBLE.replace("ens AS (SELECT base, grp,", "ens0 AS (SELECT base, entity_id, grp,").replace("SELECT base, entity_id, any_value", "SELECT base, entity_id, any_value")


@query("comparison_seeded", sql("""SELECT 'TS_vs_RB' AS comparison, 'TS' AS condition_a, 'RB' AS condition_b, count(*) AS n_seeds,
    round(avg(a.qwk), 9) AS qwk_a_mean, round(avg(b.qwk), 9) AS qwk_b_mean, round(avg(a.qwk - b.qwk), 9) AS qwk_diff_mean,
    round(stddev_pop(a.qwk - b.qwk), 9) AS qwk_diff_std,
    (SELECT count(*) FROM kg x JOIN kg y USING (grp) WHERE x.condition = 'TS' AND y.condition = 'RB' AND x.qwk > y.qwk) AS groups_positive,
    (SELECT count(*) FROM kg x JOIN kg y USING (grp) WHERE x.condition = 'TS' AND y.condition = 'RB' AND x.qwk IS NOT NULL AND y.qwk IS NOT NULL) AS groups_total,
    any_value(s.qwk_diff_mean) AS bootstrap_qwk_diff_mean, any_value(ci_lower) AS ci_lower, any_value(ci_upper) AS ci_upper, any_value(p_positive) AS p_positive
  FROM (SELECT seed, qwk FROM kc JOIN conds USING (condition) WHERE base = 'TS') a JOIN (SELECT seed, qwk FROM kc JOIN conds USING (condition) WHERE base = 'RB') b USING (seed),
    (""" + ms.summary("d").replace("CAST(seed AS BIGINT) AS seed, ", "") + ") s", "rounded", extra=",\n".join([
        _BY_COND, _ENS0, _ENS_ROUNDED, ms.cells("cg", "er", ["condition", "grp"]), ms.kappa("kg", "cg", ["condition", "grp"], True),
        ms.bootstrap("d", ["TS", "RB"], REPS, [42], "er")])))
def comparison_seeded(spark, sf):
    return rounded(compare.compare_seeded(src.predictions(spark, sf), [("TS", "RB")], REPS, 42, "keyed"))


def _results(preds):
    return m.metrics(preds, ["base", "condition"])


_B = "(SELECT qwk FROM kc WHERE condition = '{}')"
_MEAN = "(SELECT avg(qwk) FROM kc JOIN conds USING (condition) WHERE base = '{}' AND seed IS NOT NULL)"


def _q(c: str) -> str:
    return _B.format(c)


@query("gate_feasibility", sql(f"""SELECT *, CASE WHEN t3_beats_t2 AND t3_beats_shuffled AND ci_positive AND groups_consistent THEN 'GREEN'
    WHEN trees_fail AND text_fails THEN 'RED' ELSE 'YELLOW' END AS decision FROM (SELECT
    {_q('T3')} - {_q('T2')} >= 0.005 AS t3_beats_t2, {_q('T3')} - {_MEAN.format('TS')} >= 0.005 AS t3_beats_shuffled,
    bootstrap_ci_lower > 0 AS ci_positive, groups_positive / groups_total >= 0.6 AS groups_consistent,
    {_q('N2')} <= {_MEAN.format('NS')} OR {_q('N2')} <= {_q('N1')} AS trees_fail,
    {_q('T3')} <= {_MEAN.format('TS')} OR {_q('T3')} <= {_q('T2')} AS text_fails FROM cmp WHERE comparison = 'T3_vs_T2')""", "rounded", extra=_CMP_EXTRA))
def gate_feasibility(spark, sf):
    preds = src.predictions(spark, sf)
    return gates.feasibility_gate(_results(preds), compare.compare_pairs(preds, [("T3", "T2")], REPS, 42, "keyed"))


@query("gate_stress", sql(f"""SELECT *, CASE WHEN beats_random AND beats_boundaries AND ci_positive AND best_often THEN 'STRONG'
    WHEN {_q('T3')} > {_q('T2')} AND {_q('T3')} > {_MEAN.format('RND')} THEN 'PARTIAL' ELSE 'NOT YET' END AS decision FROM (SELECT
    {_q('T3')} - {_MEAN.format('RND')} >= 0.005 AS beats_random, {_q('T3')} - {_MEAN.format('RB')} >= 0.005 AS beats_boundaries,
    bootstrap_ci_lower > 0 AS ci_positive, b.c >= 9 AS best_often, b.c AS t3_best_count FROM cmp,
    (SELECT count(*) FILTER (condition = 'T3') AS c FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY qwk DESC) AS rn
      FROM k WHERE condition IN ('T2', 'T3', 'TS_s42', 'RND_s42')) WHERE rn = 1) b WHERE comparison = 'T3_vs_T2')""", "rounded", extra=_CMP_EXTRA))
def gate_stress(spark, sf):
    preds = src.predictions(spark, sf)
    best = m.best_condition(m.group_kappa(preds), "grp", ["T2", "T3", "TS_s42", "RND_s42"])
    return gates.stress_gate(_results(preds), compare.compare_pairs(preds, [("T3", "T2")], REPS, 42, "keyed"), best)


@query("gate_verification", sql(f"""SELECT *, CASE WHEN residual_beats_t2 AND t3_beats_shuffled THEN 'PROCEED TO FINAL TESTING'
    WHEN audit_ok AND signal_left THEN 'PROCEED WITH REFRAMED CLAIM' ELSE 'STOP' END AS decision FROM (SELECT
    {_q('N2')} > {_q('T2')} + 0.003 AS residual_beats_t2, {_q('T3')} - {_q('REAL_BOUNDARY_SHUFFLED_LABEL')} > 0.005 AS t3_beats_shuffled,
    {_q('POS_TRANS')} > {_q('T2')} OR {_q('N2')} > {_q('T2')} AS signal_left,
    (SELECT count(DISTINCT condition) = 28 FROM kc) AS audit_ok)""", "rounded", extra=_BY_COND))
def gate_verification(spark, sf):
    results = _results(src.predictions(spark, sf))
    residual = results.filter("condition = 'N2'").agg(F.max("qwk").alias("residual_t3"))
    audit_ok = results.agg((F.count_distinct("condition") == 28).alias("audit_ok"))
    return gates.verification_gate(results, residual, audit_ok)


_SUB = ms.cells("cs", "rounded", ["condition", "subgrp"]) + ",\n" + ms.kappa("ks", "cs", ["condition", "subgrp"])
_CORE = {"beats_text_counts": f"{_q('T3_PLUS_POS')} - {_q('T2')}", "pos_beats_t2": f"{_q('POS')} - {_q('T2')}",
         **{f"beats_mean_{b.lower()}": f"{_q('T3_PLUS_POS')} - {_MEAN.format(b)}" for b in ("TS", "RB", "RND")}}


@query("gate_claim", sql(f"""SELECT *, CASE WHEN {' AND '.join(_CORE)} AND trans_beats_pos::INT + group_consistency::INT + subgroup_consistency::INT >= 2 THEN 'CLAIM SUPPORTED'
    WHEN {' + '.join(c + '::INT' for c in _CORE)} >= 3 AND beats_text_counts THEN 'CLAIM PARTIALLY SUPPORTED' ELSE 'CLAIM NOT SUPPORTED' END AS decision FROM (SELECT
    {', '.join(f'{e} >= 0.003 AS {n}' for n, e in _CORE.items())}, {_q('POS_TRANS')} - {_q('POS')} >= 0 AS trans_beats_pos,
    (SELECT avg((x.qwk > y.qwk)::INT) FROM k x JOIN k y USING (grp) WHERE x.condition = 'T3_PLUS_POS' AND y.condition = 'T2' AND x.qwk IS NOT NULL AND y.qwk IS NOT NULL) >= 0.6 AS group_consistency,
    (SELECT count(*) FILTER (x.qwk > y.qwk) >= count(*) // 2 + 1 FROM ks x JOIN ks y USING (subgrp) WHERE x.condition = 'T3_PLUS_POS' AND y.condition = 'T2') AS subgroup_consistency)""",
  "rounded", extra=",\n".join([_GROUPS, _BY_COND, _SUB])))
def gate_claim(spark, sf):
    preds = src.predictions(spark, sf)
    results = _results(preds)
    mean = m.mean_over_seeds(results.filter("base <> condition"), [])
    scores = results.select("condition", "qwk").unionByName(mean.select("condition", "qwk"))
    pairs = m.pair_table(spark, [("T3_PLUS_POS", "T2"), ("POS", "T2"), *[("T3_PLUS_POS", f"mean_{b}") for b in ("TS", "RB", "RND")]])
    diffs = pairs.join(scores.select(F.col("condition").alias("condition_a"), F.col("qwk").alias("qa")), "condition_a").join(
        scores.select(F.col("condition").alias("condition_b"), F.col("qwk").alias("qb")), "condition_b").withColumn(
        "qwk_diff", F.col("qa") - F.col("qb"))
    return gates.claim_gate(results, diffs, m.group_kappa(preds), m.metrics_with_total(preds))


_ROBUST = {"D0": "RND", "D2": "NS", "D_SHUFFLED": "TS", "D_RANDOM": "RB"}


@query("gate_robustness", sql("""SELECT *, CASE WHEN beats_text AND beats_counts AND beats_shuffled AND beats_random AND pos_beats_counts AND group_fraction >= 0.6
      THEN 'ROBUSTNESS PARTIALLY SUPPORTED'
    WHEN beats_text::INT + beats_counts::INT + beats_shuffled::INT + beats_random::INT + pos_beats_counts::INT >= 3 AND beats_counts THEN 'ROBUSTNESS PARTIALLY SUPPORTED'
    ELSE 'ROBUSTNESS NOT SUPPORTED' END AS decision FROM (SELECT
    {s} - {rnd} >= 0.003 AS beats_text, {s} - {ns} >= 0.003 AS beats_counts, {s} - {ts} >= 0.003 AS beats_shuffled, {s} - {rb} >= 0.003 AS beats_random,
    {p} - {ns} >= 0.003 AS pos_beats_counts,
    (SELECT avg((x.qwk > y.q)::INT) FROM k x JOIN (SELECT grp, avg(qwk) AS q FROM k JOIN conds USING (condition) WHERE base = 'NS' GROUP BY grp) y USING (grp)
     WHERE x.condition = 'T3_PLUS_POS') AS group_fraction)""".format(
    s=_q("T3_PLUS_POS"), p=_q("POS"), rnd=_MEAN.format("RND"), ns=_MEAN.format("NS"), ts=_MEAN.format("TS"), rb=_MEAN.format("RB")),
  "rounded", extra=_GROUPS + ",\n" + _BY_COND))
def gate_robustness(spark, sf):
    preds = src.predictions(spark, sf)
    results = _results(preds)
    roles = {"D_STRUCT": "T3_PLUS_POS", "D_POS": "POS", **_ROBUST}
    scores = results.groupBy("base").agg(F.avg("qwk").alias("qwk"))
    named = F.create_map(*[F.lit(x) for r, b in roles.items() for x in (b, r)])
    scores = scores.withColumn("condition", F.try_element_at(named, F.col("base")))
    pairs = m.pair_table(spark, [("D_STRUCT", c) for c in ("D0", "D2", "D_SHUFFLED", "D_RANDOM")] + [("D_POS", "D2")])
    diffs = pairs.join(scores.select(F.col("condition").alias("condition_a"), F.col("qwk").alias("qa")), "condition_a").join(
        scores.select(F.col("condition").alias("condition_b"), F.col("qwk").alias("qb")), "condition_b").withColumn(
        "qwk_diff_mean", F.col("qa") - F.col("qb"))
    groups = m.group_kappa(preds, ["base", "condition", "grp"]).groupBy("base", "grp").agg(F.avg("qwk").alias("qwk_mean")).withColumn(
        "condition", F.try_element_at(named, F.col("base")))
    return gates.robustness_gate(diffs, groups, len(CONTROL_SEEDS))
