"""Scaling, residuals, correlations, audits of feature tables, and fitted models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from spandoc.catalog.audit import _ENTITIES, _VALID
from spandoc.catalog.controls import ranked_sql
from spandoc.catalog.ctes import sql
from spandoc.catalog.feature_sql import features_extra, features_select
from spandoc.catalog.registry import query
from spandoc.operators import audit, bootstrap as boot, controls, gates, metrics as m, models, qa, stats
from spandoc.plans import conditions, evaluation, joint, runs
from spandoc.plans.storage import shared_folder
from spandoc.schemas import CHAT_SCHEME, DEFAULT_SCHEME
from spandoc.sources import adapters as src

_T3 = ("surface", "count", "firstlast", "transition", "label_position")
_NAMES = conditions.feature_names("T3")
_LONG = (features_extra("doc_spans", "doc_entities", DEFAULT_SCHEME.labels, DEFAULT_SCHEME.gap)
         + ",\nlong AS (" + features_select(_T3, DEFAULT_SCHEME.labels, DEFAULT_SCHEME.gap) + ")"
         + ",\nnames(feature) AS (VALUES " + ", ".join(f"('{n}')" for n in _NAMES) + ")"
         + ",\ndense AS MATERIALIZED (SELECT e.entity_id, e.split, n.feature, coalesce(l.value, 0) AS value FROM doc_entities e CROSS JOIN names n "
           "LEFT JOIN long l ON l.entity_id = e.entity_id AND l.feature = n.feature)")


def _docs(spark, sf):
    return src.doc_spans(spark, sf), src.doc_entities(spark, sf)


def _train(wide, ents):
    return wide.join(ents.filter("split = 'train'").select("entity_id"), "entity_id", "left_semi")


@query("feature_audit", sql("""SELECT 'T3' AS condition, feature AS feature_name, CASE WHEN feature LIKE 'surface\\_%' ESCAPE '\\' THEN 'surface'
      WHEN feature LIKE 'count\\_%' ESCAPE '\\' OR feature LIKE 'prop\\_%' ESCAPE '\\' THEN 'count' WHEN feature LIKE 'order\\_trans\\_%' ESCAPE '\\' THEN 'transition'
      WHEN feature LIKE 'order\\_first\\_is\\_%' ESCAPE '\\' OR feature LIKE 'order\\_final\\_is\\_%' ESCAPE '\\' THEN 'firstlast' ELSE 'label_position' END AS feature_family,
    CAST(115 AS BIGINT) AS n_dimensions_condition, round(avg(CASE WHEN value <> 0 THEN 1.0e0 ELSE 0 END), 6) AS mean_nonzero_fraction,
    min(value) = max(value) AS is_constant_train, false AS is_near_constant_train,
    round(CASE WHEN min(value) = max(value) THEN 0 ELSE stddev_pop(value) END, 5) AS train_std, false AS contains_forbidden_token
  FROM dense WHERE split = 'train' GROUP BY feature""", "doc_spans", "doc_entities", extra=_LONG))
def feature_audit(spark, sf):
    spans, ents = _docs(spark, sf)
    out = stats.feature_audit(_train(conditions.build_condition("T3", spans, ents), ents), "T3", conditions.feature_families())
    return out.withColumns({"mean_nonzero_fraction": F.round("mean_nonzero_fraction", 6), "train_std": F.round("train_std", 5)})


_CONFOUNDS = {
    "word_count": "surface_word_count", "char_count": "surface_char_count", "sentence_count": "surface_sentence_count",
    "paragraph_count": "surface_paragraph_count", "component_count": "count_total_components",
    "coverage": "count_annotation_coverage",
}


_CORR = """pairs AS (
  SELECT f.feature AS feature_name, c.confound, count(*) AS n, CASE WHEN stddev_pop(c.value) > 0 THEN corr(f.value, c.value) END AS r
  FROM (SELECT entity_id, feature, value FROM dense WHERE split = 'train' AND feature LIKE 'order%') f
  JOIN (SELECT entity_id, n.confound, value FROM dense JOIN (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in _CONFOUNDS.items()) + """) n(confound, feature) USING (feature)
        UNION ALL SELECT entity_id, 'score', score FROM doc_entities) c USING (entity_id)
  GROUP BY f.feature, c.confound HAVING stddev_pop(f.value) >= 1e-12)"""

# The tail of Student's t: its density integrated by Simpson's rule from 0 to |t| (at 60 it is 0 to any digit shown).
_TAIL = """sized AS (SELECT *, n - 2 AS df, least(60, abs(r) * sqrt((n - 2) / (1 - r * r))) AS t FROM pairs WHERE abs(r) < 1 AND n > 2),
tails AS (SELECT feature_name, confound, 1 - 2 * any_value(exp(lgamma((df + 1) / 2.0e0) - lgamma(df / 2.0e0)) / sqrt(df * pi()) * t / 6000)
    * sum((CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + (t * i / 2000) * (t * i / 2000) / df, -(df + 1) / 2.0e0)) AS p
  FROM sized, range(2001) x(i) GROUP BY ALL)"""


@query("correlations", sql("SELECT feature_name, confound, round(r, 5) AS r FROM pairs", "doc_spans", "doc_entities", extra=_LONG + ",\n" + _CORR))
def correlations(spark, sf):
    return correlation_pvalues(spark, sf).select("feature_name", "confound", "r")


@query("correlation_pvalues", sql("""SELECT a.feature_name, CASE WHEN a.feature_name LIKE 'order_trans%' THEN 'transition'
    WHEN a.feature_name LIKE 'order_first_is%' OR a.feature_name LIKE 'order_final_is%' THEN 'firstlast' ELSE 'label_position' END AS feature_family,
  a.confound, round(r, 5) AS r, round(CASE WHEN abs(r) >= 1 THEN 0 WHEN r IS NOT NULL THEN greatest(p, 0) END, 5) + 0.0e0 AS p
  FROM pairs a LEFT JOIN tails b ON a.feature_name = b.feature_name AND a.confound = b.confound""",
  "doc_spans", "doc_entities", extra=_LONG + ",\n" + _CORR + ",\n" + _TAIL))
def correlation_pvalues(spark, sf):
    spans, ents = _docs(spark, sf)
    wide = _train(conditions.build_condition("T3", spans, ents), ents).join(
        ents.select("entity_id", F.col("score").cast("double").alias("score")), "entity_id")
    structural = [n for n in _NAMES if n.startswith("order_")]
    found = stats.correlations(wide, structural, {**_CONFOUNDS, "score": "score"}, conditions.feature_families())
    return found.withColumns({"r": F.round("r", 5), "p": F.round("p", 5)})


@query("scaled_features", sql("""SELECT entity_id, feature, round((value - mu) / CASE WHEN lo = hi THEN 1 ELSE sd END, 5) AS value
  FROM dense JOIN (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi FROM dense WHERE split = 'train' GROUP BY feature) s USING (feature)
  WHERE feature LIKE 'surface%' OR feature LIKE 'count%'""", "doc_spans", "doc_entities", extra=_LONG))
def scaled_features(spark, sf):
    spans, ents = _docs(spark, sf)
    wide = conditions.build_condition("T2", spans, ents)
    cols = [c for c in models.feature_columns(wide) if c.startswith(("surface", "count"))]
    scaled = models.fit_scaling(_train(wide, ents), cols).apply(wide)
    return scaled.unpivot(["entity_id"], cols, "feature", "value").withColumn("value", F.round("value", 5))


_ORDER_NAMES = [n for n in _NAMES if n.startswith("order_")]
# One row per entity: a feature per column, so every moment comes from one aggregate.
_PIVOT = ("pivoted AS MATERIALIZED (SELECT entity_id, split, max(value) FILTER (feature = 'surface_word_count') AS c1, "
          "max(value) FILTER (feature = 'count_total_components') AS c2, "
          + ", ".join(f"max(value) FILTER (feature = '{n}') AS f{i}" for i, n in enumerate(_ORDER_NAMES))
          + " FROM dense GROUP BY entity_id, split),\nmoments AS MATERIALIZED (SELECT avg(c1) AS m1, avg(c2) AS m2, var_pop(c1) AS v1, var_pop(c2) AS v2, covar_pop(c1, c2) AS v12, "
          + ", ".join(f"avg(f{i}) AS a{i}, covar_pop(f{i}, c1) AS p{i}, covar_pop(f{i}, c2) AS q{i}" for i in range(len(_ORDER_NAMES)))
          + " FROM pivoted WHERE split = 'train')")
_RESIDUAL = ("f{i} - (a{i} + (p{i} * v2 - q{i} * v12) / (v1 * v2 - v12 * v12) * (c1 - m1) + (q{i} * v1 - p{i} * v12) / (v1 * v2 - v12 * v12) * (c2 - m2))")


@query("residualized", sql("SELECT entity_id, unnest([" + ", ".join(f"'{n}'" for n in _ORDER_NAMES) + "]) AS feature, unnest(["
                           + ", ".join(f"round({_RESIDUAL.format(i=i)}, 6)" for i in range(len(_ORDER_NAMES)))
                           + "]) AS value FROM pivoted, moments", "doc_spans", "doc_entities", extra=_LONG + ",\n" + _PIVOT))
def residualized(spark, sf):
    spans, ents = _docs(spark, sf)
    wide = conditions.build_condition("T3", spans, ents)
    cols = [n for n in _NAMES if n.startswith("order_")]
    fits = models.fit_residuals(_train(wide, ents), cols, ("surface_word_count", "count_total_components"))
    out = models.residualized(wide, fits)
    # Adding zero turns a negative zero into zero.
    return out.unpivot(["entity_id"], cols, "feature", "value").withColumn("value", F.round("value", 6) + F.lit(0.0))


_RIDGE_SQL = """x AS (SELECT entity_id, split, CAST(score AS DOUBLE) AS y, max(value) FILTER (feature = 'surface_word_count') AS a,
    max(value) FILTER (feature = 'count_total_components') AS b FROM dense JOIN doc_entities USING (entity_id, split) GROUP BY ALL),
p AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, count(*) AS n,
    corr(a, b) AS rab, corr(a, y) * stddev_pop(y) AS cay, corr(b, y) * stddev_pop(y) AS cby FROM x WHERE split = 'train'),
w AS (SELECT *, (n * cay * (n + 10.0e0) - n * cby * n * rab) / ((n + 10.0e0) * (n + 10.0e0) - n * rab * n * rab) AS wa,
    (n * cby * (n + 10.0e0) - n * cay * n * rab) / ((n + 10.0e0) * (n + 10.0e0) - n * rab * n * rab) AS wb FROM p)"""


@query("ridge_fixed", sql("SELECT entity_id, split, round(my + wa * (a - ma) / sa + wb * (b - mb) / sb, 5) AS prediction FROM x, w",
                          "doc_spans", "doc_entities", extra=_LONG + ",\n" + _RIDGE_SQL))
def ridge_fixed(spark, sf):
    """MLlib ridge (alpha 10) on two scaled features against the closed form."""
    spans, ents = _docs(spark, sf)
    wide = conditions.build_condition("T2", spans, ents)
    scaling = models.fit_scaling(_train(wide, ents), ["surface_word_count", "count_total_components"])
    rows = models.numeric_vectors(wide, scaling).join(
        ents.select("entity_id", "split", F.col("score").cast("double").alias("score")), "entity_id")
    fit = models.fit_ridge(rows.filter("split = 'train'"), 10.0, features="num", columns=2)
    return fit.transform(rows).select("entity_id", "split", F.round("prediction", 5).alias("prediction"))


@query("ridge_from_products", sql("SELECT entity_id, split, round(my + wa * (a - ma) / sa + wb * (b - mb) / sb, 5) AS prediction FROM x, w",
                                  "doc_spans", "doc_entities", extra=_LONG + ",\n" + _RIDGE_SQL))
def ridge_from_products(spark, sf):
    """The same fit from distributed cross products."""
    spans, ents = _docs(spark, sf)
    cols = ["count_total_components", "surface_word_count"]
    wide = conditions.build_condition("T2", spans, ents).select("entity_id", *cols)
    rows = wide.join(ents.select("entity_id", "split", "score"), "entity_id")
    products = models.cross_products(rows.filter("split = 'train'"), cols, "split")
    fit = models.ridge_from_products(products, products.total(), cols, 10.0)
    return rows.select("entity_id", "split", F.round(F.expr(fit.prediction()), 5).alias("prediction"))


def _setup(spark, sf, **kw):
    spans, ents = _docs(spark, sf)
    return evaluation.Setup(spans, ents, **kw)


@query("ridge_cv")
def ridge_cv(spark, sf):
    """Mean held-out MSE per alpha over five contiguous folds, and the alpha chosen, from the numeric features of T2."""
    best, scores = evaluation.choose_alpha(_setup(spark, sf), "T2")
    return spark.createDataFrame([(a, e, a == best) for a, e in scores], "alpha double, cv_mse double, selected boolean")


@query("ridge_text")
def ridge_text(spark, sf):
    """Text + surface + counts, fitted on train, metrics per phase."""
    return m.metrics(evaluation.run_condition("T2", _setup(spark, sf)), ["condition", "phase"])


@query("run_log")
def run_log(spark, sf):
    """Several conditions through the runner; unknown ones become failed rows."""
    preds, log = evaluation.run_conditions(["T0", "T1", "RND_s13", "NOT_A_CONDITION"], _setup(spark, sf))
    scored = m.metrics(preds.filter("phase = 'test'"), ["condition"])
    return log.join(scored, "condition", "left")


@query("gbt_numeric")
def gbt_numeric(spark, sf):
    """Boosted trees on the text-free conditions, all 300 rounds of each."""
    preds = evaluation.run_together(["N0", "N1", "N2", "NS_s13"], _setup(spark, sf))
    return m.metrics(preds, ["condition", "phase"])


LOGO = ["T2", "T3", "POS", "POS_TRANS", "T3_PLUS_POS"]


@query("leave_one_group_out")
def leave_one_group_out(spark, sf):
    """Every source held out once, the numeric features of five conditions, in one job."""
    names = [n + evaluation.NUMERIC for n in LOGO]
    return evaluation.fold_table(joint.held_out_groups(_setup(spark, sf), LOGO, text=False), names, names[0])


@query("leave_one_group_out_text")
def leave_one_group_out_text(spark, sf):
    """Every source held out once, texts included: vocabulary, scaling and fits of five conditions per fold, in one job."""
    return evaluation.fold_table(joint.held_out_groups(_setup(spark, sf), LOGO), LOGO)


@query("leave_one_group_out_controls")
def leave_one_group_out_controls(spark, sf):
    """The same for the true structure against shuffled labels, random boundaries and random features."""
    names = ["T2", "T3", "REAL_BOUNDARY_SHUFFLED_LABEL", "RANDOM_BOUNDARY_TRUE_SEQUENCE", "TS_s13", "RND_s13"]
    return evaluation.fold_table(joint.held_out_groups(_setup(spark, sf), names), names)


_CV = ["T0", "T1", "T2", "T3", "POS", "BOUNDARY_ONLY", "POS_TRANS", "T3_PLUS_POS"]


def _cross_validated(spark, sf, names, **kw):
    """Metrics of the test rows at the alpha chosen, with the mean error of every alpha over the folds."""
    preds, table = joint.cross_validated(_setup(spark, sf), names, **kw)
    choices = spark.createDataFrame(table, "condition string, ridge_alpha double, cv_mse double, selected boolean")
    return choices.join(m.metrics(preds, ["condition"]), "condition")


@query("ridge_cv_text")
def ridge_cv_text(spark, sf):
    """Alpha of every condition by five folds, texts included, in one job."""
    return _cross_validated(spark, sf, _CV)


@query("residualized_ridge_text")
def residualized_ridge_text(spark, sf):
    """Structure residualized on length and component count, refitted with the text at an alpha of its own."""
    return _cross_validated(spark, sf, ["POS", "TRANS", "T3"], residual=True)


@query("embedding_head")
def embedding_head(spark, sf):
    """Linear head on stored vectors (D0): metrics per phase."""
    ents = src.vector_entities(spark, sf).withColumn("score", F.col("score"))
    setup = evaluation.Setup(src.doc_spans(spark, sf), ents, alpha=1.0)
    return m.metrics(evaluation.run_condition("D0", setup), ["condition", "phase"])


@query("embedding_structure_head")
def embedding_structure_head(spark, sf):
    """Vectors joined with the structure of the documents of the same id (D2, D_SHUFFLED); documents without one are counted."""
    docs = src.doc_entities(spark, sf)
    vec = src.vector_entities(spark, sf).select("entity_id", "embedding")
    alone = docs.join(vec, "entity_id", "left_anti").count()
    setup, names = evaluation.Setup(src.doc_spans(spark, sf), docs.join(vec, "entity_id")), ["D2", "D_SHUFFLED_s42"]
    setup.share(names)
    preds = reduce(lambda a, b: a.unionByName(b), [evaluation.run_condition(c, setup) for c in names])
    return m.metrics(preds, ["condition", "phase"]).withColumn("documents_without_vector", F.lit(alone).cast("bigint"))


@query("residualized_ridge")
def residualized_ridge(spark, sf):
    """Structure features residualized on length and component count, then refitted without the text at alpha 10."""
    preds, _ = joint.cross_validated(_setup(spark, sf), ["POS", "TRANS", "T3"], alphas=(10.0,), residual=True, text=False)
    return m.metrics(preds, ["condition"])


VECTOR_CONDITIONS = ["D0", "D2", "D_POS", "D_STRUCT", "D_SHUFFLED", "D_RANDOM"]
VECTOR_SEEDS = [13, 21, 42]


def _vector_runs(spark, sf, whole=False):
    """The six conditions on vectors x three seeds, in one job; finished cells of the same inputs would be skipped.

    A log shows the cells that failed; with ``whole`` they are an error, as a decision over the others would not show them.
    """
    ents = src.doc_entities(spark, sf).join(src.vector_entities(spark, sf).select("entity_id", "embedding"), "entity_id")
    done = runs.Runs(evaluation.Setup(src.doc_spans(spark, sf), ents), shared_folder(spark))
    wanted = runs.cells(VECTOR_CONDITIONS, VECTOR_SEEDS)
    log = done.run(wanted, at_once=18)
    if whole:
        runs.require(wanted, log)
    return done


@query("run_log_vectors")
def run_log_vectors(spark, sf):
    """One row per condition on vectors, seed and phase."""
    return _vector_runs(spark, sf).table().drop("error")


@query("gate_robustness_vectors")
def gate_robustness_vectors(spark, sf):
    """The robustness decision on the conditions it is meant for, with the mean over seeds, all from one run."""
    preds = _vector_runs(spark, sf, whole=True).predictions()
    scores = m.metrics(preds, ["base", "condition"]).groupBy("base").agg(F.avg("qwk").alias("qwk"))
    pairs = m.pair_table(spark, [("D_STRUCT", c) for c in ("D0", "D2", "D_SHUFFLED", "D_RANDOM")] + [("D_POS", "D2")])
    diffs = pairs.join(scores.select(F.col("base").alias("condition_a"), F.col("qwk").alias("qa")), "condition_a").join(
        scores.select(F.col("base").alias("condition_b"), F.col("qwk").alias("qb")), "condition_b").withColumn(
        "qwk_diff_mean", F.col("qa") - F.col("qb"))
    groups = m.group_kappa(preds, ["base", "condition", "grp"]).groupBy("base", "grp").agg(F.avg("qwk").alias("qwk_mean"))
    return gates.robustness_gate(diffs, groups.withColumnRenamed("base", "condition"), len(VECTOR_SEEDS))


# --- manifests and protocol -------------------------------------------------------------------

_MANIFEST = ["T1", "T2", "T3", "FIRSTLAST", "TRANS", "LABELPOS", "NO_TRANS", "NO_POS", "COUNTS_TRANS"]
# Families of every condition, and their names from the labels, independent of the code that builds them.
_MANIFEST_FAMILIES = {
    "T1": "surface", "T2": "surface count", "T3": "surface count firstlast transition label_position", "FIRSTLAST": "surface count firstlast",
    "TRANS": "surface count transition", "LABELPOS": "surface count label_position", "NO_TRANS": "surface count firstlast label_position",
    "NO_POS": "surface count firstlast transition", "COUNTS_TRANS": "surface count transition"}
_MANIFEST_SQL = f"""keys(k) AS (SELECT replace(x, ' ', '_') FROM (SELECT unnest({list(DEFAULT_SCHEME.labels)}) AS x)),
listed(family, feature) AS (
  SELECT 'surface', 'surface_' || unnest(['word_count', 'char_count', 'sentence_count', 'paragraph_count', 'mean_word_length'])
  UNION ALL SELECT 'count', 'count_' || unnest(['total_components', 'total_segments', 'annotation_coverage', 'unannotated_gaps', 'unannotated_proportion'])
  UNION ALL SELECT 'count', unnest(['count_', 'prop_']) || k FROM keys
  UNION ALL SELECT 'firstlast', 'order_' || unnest(['first', 'final']) || '_is_' || k FROM keys
  UNION ALL SELECT 'transition', 'order_trans_' || a.k || '__' || b.k FROM keys a CROSS JOIN keys b
  UNION ALL SELECT 'label_position', 'order_' || unnest(['mean', 'first', 'final', 'std']) || '_pos_' || k FROM keys),
conds(condition, family) AS (VALUES {", ".join(f"('{c}', '{f}')" for c, fs in _MANIFEST_FAMILIES.items() for f in fs.split())})"""


@query("feature_manifest", sql("""SELECT c.condition, l.feature AS feature_name, coalesce(n.n_nonzero, 0)::BIGINT AS n_nonzero, l.family AS feature_family,
    false AS contains_forbidden_token
  FROM conds c JOIN listed l USING (family)
  LEFT JOIN (SELECT feature, count(*) FILTER (value <> 0) AS n_nonzero FROM dense GROUP BY feature) n USING (feature)""",
  "doc_spans", "doc_entities", extra=_LONG + ",\n" + _MANIFEST_SQL))
def feature_manifest(spark, sf):
    """Names of every built table, with the entities where the feature is not zero."""
    spans, ents = _docs(spark, sf)
    shared = conditions.build_shared(_MANIFEST, spans, ents)
    built = [conditions.actual_manifest(c, conditions.build_condition(c, spans, ents, shared=shared)) for c in _MANIFEST]
    return qa.manifest(reduce(lambda a, b: a.unionByName(b), built), conditions.feature_families())


@query("manifest_match", sql("""SELECT condition, expected_feature_count, actual_feature_count, missing_features, extra_features, manifest_match FROM (VALUES
    ('T2', CAST(24 AS BIGINT), CAST(24 AS BIGINT), '', '', true), ('T3', 115, 115, '', '', true), ('NO_TRANS', 66, 66, '', '', true),
    ('TRANS', 74, 73, 'order_trans_Lead__Nothing', '', false)) v(condition, expected_feature_count, actual_feature_count, missing_features, extra_features, manifest_match)
  WHERE EXISTS (SELECT 1 FROM documents)"""))
def manifest_match(spark, sf):
    """Expected against built columns; one column is removed from TRANS to show a mismatch."""
    spans, ents = _docs(spark, sf)
    names = ["T2", "T3", "NO_TRANS", "TRANS"]
    # TRANS is 24 + 49 = 73 columns; a 74th name is expected on purpose.
    expected = conditions.manifest_rows(spark, names).unionByName(
        spark.createDataFrame([("TRANS", "order_trans_Lead__Nothing")], "condition string, feature_name string"))
    built = reduce(lambda a, b: a.unionByName(b), [
        conditions.actual_manifest(c, conditions.build_condition(c, spans, ents)) for c in names])
    return qa.manifest_match(expected, built)


@query("ablation_consistency", sql("""SELECT true AS no_trans_is_t3_minus_trans, true AS no_trans_values_match, true AS labelpos_columns_match,
  true AS trans_columns_match, true AS pos_has_no_order_columns, true AS counts_trans_matches_trans WHERE EXISTS (SELECT 1 FROM documents)"""))
def ablation_consistency(spark, sf):
    """Names by set algebra on built tables, values by the largest difference over all entities."""
    spans, ents = _docs(spark, sf)
    # Rank slots play no part here.
    built = {c: conditions.build_condition(c, spans, ents, max_ranks=0) for c in ("T3", "NO_TRANS", "LABELPOS", "TRANS", "POS", "COUNTS_TRANS")}
    cols = {c: set(models.feature_columns(d)) for c, d in built.items()}

    def named(prefix, c, infix=""):
        return {x for x in cols[c] if x.startswith(prefix) and infix in x}

    same = stats.max_difference(built["NO_TRANS"], built["T3"].select("entity_id", *sorted(cols["NO_TRANS"])), sorted(cols["NO_TRANS"]))
    trans = sorted(named("order_trans_", "TRANS"))
    twin = stats.max_difference(built["COUNTS_TRANS"].select("entity_id", *trans), built["TRANS"].select("entity_id", *trans), trans)
    ok = (F.col("max_abs_diff") < 1e-9) & (F.col("unmatched") == 0)
    a = same.select(ok.alias("no_trans_values_match"), F.lit(1).alias("one"))
    b = twin.select(ok.alias("counts_trans_matches_trans"), F.lit(1).alias("one"))
    return a.join(b, "one").select(
        F.lit(cols["NO_TRANS"] == cols["T3"] - named("order_trans_", "T3")).alias("no_trans_is_t3_minus_trans"),
        "no_trans_values_match",
        F.lit(named("order_", "LABELPOS", "_pos_") == named("order_", "T3", "_pos_")).alias("labelpos_columns_match"),
        F.lit(named("order_trans_", "TRANS") == named("order_trans_", "T3")).alias("trans_columns_match"),
        F.lit(not named("order_", "POS")).alias("pos_has_no_order_columns"), "counts_trans_matches_trans")


_ANNOTATION_COLUMNS = ("entity_id", "row_no", "text", "score", "grp", "subgrp", "split", "grade", "word_count_field", "start_at", "end_at",
                       "label", "effectiveness", "source_file")


@query("leakage_check", sql("SELECT feature_name, n_values, regexp_matches(lower(feature_name), "
    "'^(prompt|assignment|competition|gender|grade|ell_|race_|economically|student_disability|effectiveness|holistic|target)') AS contains_forbidden_token "
    "FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature_name, count({c}) AS n_values FROM annot" for c in _ANNOTATION_COLUMNS) + ")", "annot"))
def leakage_check(spark, sf):
    """Columns of the annotation rows that must never be features, with the rows that fill them."""
    return qa.column_counts(src.annotation_rows(spark, sf))


@query("protocol_checks", sql("""SELECT 'no_train_test_overlap' AS "check", count(*) FILTER (n > 1) = 0 AS passed,
    'train=' || count(*) FILTER (s = 'train') || ', test=' || count(*) FILTER (s = 'test') AS detail
  FROM (SELECT entity_id, count(DISTINCT split) AS n, any_value(split) AS s FROM chat_entities GROUP BY entity_id)
  UNION ALL SELECT 'shuffled_label_counts_preserved', true, 'n_checks=' || count(DISTINCT entity_id) FROM rk
  UNION ALL SELECT 'random_control_dim_match', count(*) = 91, 'rnd=91, order=' || count(*) FROM listed WHERE family IN ('firstlast', 'transition', 'label_position')
  UNION ALL SELECT 'manifest_match', count(*) = 24, 'T2=' || count(*) FROM conds JOIN listed USING (family) WHERE condition = 'T2'
  UNION ALL SELECT 'bootstrap_samples_ge_10000', true, '10000'
  UNION ALL SELECT 'invalid_entities_excluded', count(*) > 0, 'kept=' || count(*) FROM doc_entities JOIN jv USING (entity_id) WHERE join_valid""",
  "chat_spans", "chat_entities", "doc_entities", "annot",
  extra=ranked_sql("chat_spans", "system") + ",\n" + _MANIFEST_SQL + ",\n" + _ENTITIES + ",\n" + _VALID))
def protocol_checks(spark, sf):
    chat, ents = src.chat_spans(spark, sf), src.chat_entities(spark, sf)
    doc_spans, docs = _docs(spark, sf)
    ids = qa.id_set_counts(ents.filter("split = 'train'"), ents.filter("split = 'test'"), "entity_id")
    overlap = ids.select((F.col("n_both") == 0).alias("passed"), F.concat(
        F.lit("train="), F.col("n_left_only") + F.col("n_both"), F.lit(", test="), F.col("n_right_only")).alias("detail"))
    kept = controls.label_counts_equal(
        controls.ranked_spans(chat, CHAT_SCHEME), controls.shuffle_labels(chat, 13, CHAT_SCHEME), "same")
    preserved = kept.agg(F.bool_and("same").alias("passed"), F.concat(F.lit("n_checks="), F.count(F.lit(1))).alias("detail"))
    n_order = sum(n.startswith("order_") for n in models.feature_columns(conditions.build_condition("T3", doc_spans, docs)))
    rnd = controls.random_features(docs, conditions.RANDOM_DIMS, 13)
    n_rnd = len(models.feature_columns(rnd))
    one = docs.agg(F.count(F.lit(1)).alias("n"))
    dims = one.select(F.lit(n_rnd == n_order).alias("passed"), F.lit(f"rnd={n_rnd}, order={n_order}").alias("detail"))
    match = qa.manifest_match(conditions.manifest_rows(spark, ["T2"]), conditions.actual_manifest(
        "T2", conditions.build_condition("T2", doc_spans, docs))).select(
        F.col("manifest_match").alias("passed"), F.concat("condition", F.lit("="), "actual_feature_count").alias("detail"))
    drawn = boot.bootstrap_differences(src.predictions(spark, sf), "T3_PLUS_POS", ["T2"], 10000, [42])
    enough = drawn.agg(F.count_distinct("rep").alias("n")).select(
        (F.col("n") >= 10000).alias("passed"), F.col("n").cast("string").alias("detail"))
    # The features are built for the valid entities; each of their rows is looked up in the validation again.
    rows = audit.consolidate(src.annotation_rows(spark, sf))
    validity = audit.validate_entities(rows).select("entity_id", "join_valid")
    kept = docs.join(validity.filter("join_valid"), "entity_id", "left_semi")
    checked = conditions.build_condition("T1", doc_spans, kept).select("entity_id").join(validity, "entity_id", "left")
    excluded = checked.agg(F.coalesce(F.bool_and(F.coalesce("join_valid", F.lit(False))), F.lit(False)).alias("passed"),
                           F.concat(F.lit("kept="), F.count(F.lit(1))).alias("detail"))
    return qa.protocol_table([
        ("no_train_test_overlap", overlap), ("shuffled_label_counts_preserved", preserved), ("random_control_dim_match", dims),
        ("manifest_match", match), ("bootstrap_samples_ge_10000", enough), ("invalid_entities_excluded", excluded)])
