"""Falsification controls, their invariants, and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from spandoc.catalog.ctes import h, sql
from spandoc.catalog.registry import query
from spandoc.operators import controls, qa, splits, structure
from spandoc.schemas import CHAT_SCHEME, DEFAULT_SCHEME, FLAG_SCHEME
from spandoc.sources import adapters as src

SEED = 13


def ranked_sql(spans: str, gap: str, name: str = "rk") -> str:
    return (f"{name} AS (SELECT entity_id, label, start_at, end_at, row_number() OVER (PARTITION BY entity_id ORDER BY start_at, end_at, label, k) AS k "
            f"FROM {spans} WHERE label <> '{gap}')")


def shuffled_sql(seed: int = SEED, source: str = "rk", name: str = "sh") -> str:
    return (f"{name} AS (SELECT entity_id, k, r.start_at, r.end_at, m.label FROM {source} r JOIN (SELECT entity_id, label, "
            f"row_number() OVER (PARTITION BY entity_id ORDER BY md5('{seed}|' || entity_id || '|' || k)) AS k FROM {source}) m USING (entity_id, k))")


def boundaries_sql(ents: str, seed: int = SEED, source: str = "rk", name: str = "rb") -> str:
    """Random compositions: repeated keyed draws, or a keyed permutation when draws repeat too often."""
    return f"""{name}_z AS (SELECT entity_id, count(*) AS n, any_value(char_count) AS len FROM {source} JOIN {ents} USING (entity_id) GROUP BY entity_id),
{name}_d AS (SELECT entity_id, n, cut, min(i) AS i FROM (SELECT entity_id, n, i, {h(str(seed), "entity_id", "'cut'", "i")} % (len - 1) + 1 AS cut
    FROM (SELECT *, unnest(range(1, (n - 1) * 4 + 65)) AS i FROM {name}_z WHERE n > 1 AND len >= n)) GROUP BY entity_id, n, cut),
{name}_ok AS (SELECT entity_id FROM {name}_d GROUP BY entity_id HAVING count(*) >= any_value(n) - 1),
{name}_p AS (SELECT entity_id, n, x AS cut, row_number() OVER (PARTITION BY entity_id ORDER BY md5('{seed}|' || entity_id || '|perm|' || x)) AS i
    FROM (SELECT *, unnest(range(1, len)) AS x FROM {name}_z WHERE n > 1 AND len >= n AND entity_id NOT IN (SELECT entity_id FROM {name}_ok))),
{name}_c AS (SELECT entity_id, cut FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY i) AS rn FROM {name}_d WHERE entity_id IN (SELECT entity_id FROM {name}_ok)) WHERE rn <= n - 1
    UNION ALL SELECT entity_id, cut FROM {name}_p WHERE i <= n - 1
    UNION ALL SELECT entity_id, 0 FROM {name}_z WHERE n = 1 OR len >= n),
{name} AS (SELECT entity_id, row_number() OVER w AS k, CAST(cut AS BIGINT) AS start_at, CAST(coalesce(lead(cut) OVER w, len) - 1 AS BIGINT) AS end_at
    FROM {name}_c JOIN {name}_z USING (entity_id) WINDOW w AS (PARTITION BY entity_id ORDER BY cut)
    UNION ALL SELECT entity_id, i + 1, i, least(i, len - 1) FROM (SELECT *, unnest(range(n)) AS i FROM {name}_z WHERE n > 1 AND len < n))"""


_CHAT = ranked_sql("chat_spans", "system")
_DOCS = ranked_sql("doc_spans", "Unannotated")


@query("shuffle_labels", sql("SELECT * FROM sh", "chat_spans", extra=_CHAT + ",\n" + shuffled_sql()))
def shuffle_labels(spark, sf):
    return controls.shuffle_labels(src.chat_spans(spark, sf), SEED, CHAT_SCHEME)


@query("shuffle_labels_order_lines", sql("SELECT * FROM sh", "order_line_spans", extra=ranked_sql("order_line_spans", "none") + ",\n" + shuffled_sql()))
def shuffle_labels_order_lines(spark, sf):
    return controls.shuffle_labels(src.order_line_spans(spark, sf), SEED, FLAG_SCHEME)


@query("random_boundaries", sql("SELECT entity_id, k AS rank, start_at, end_at FROM rb", "doc_spans", "doc_entities",
                                extra=_DOCS + ",\n" + boundaries_sql("doc_entities")))
def random_boundaries(spark, sf):
    spans, ents = src.doc_spans(spark, sf), src.doc_entities(spark, sf)
    return controls.random_boundaries(controls.span_sizes(spans, ents), SEED)


@query("random_boundary_shuffled", sql("SELECT entity_id, k, rb.start_at, rb.end_at, sh.label FROM rb JOIN sh USING (entity_id, k)",
                                       "doc_spans", "doc_entities", extra=",\n".join([_DOCS, shuffled_sql(), boundaries_sql("doc_entities")])))
def random_boundary_shuffled(spark, sf):
    return controls.altered_spans("random_boundaries", src.doc_spans(spark, sf), src.doc_entities(spark, sf), SEED)


@query("random_boundary_true_sequence", sql("SELECT entity_id, k, rb.start_at, rb.end_at, rk.label FROM rb JOIN rk USING (entity_id, k)",
                                            "chat_spans", "chat_entities", extra=_CHAT + ",\n" + boundaries_sql("chat_entities")))
def random_boundary_true_sequence(spark, sf):
    return controls.altered_spans("random_boundaries_true_order", src.chat_spans(spark, sf), src.chat_entities(spark, sf), SEED, CHAT_SCHEME)


def _uniform(tag: str) -> str:
    return f"({h(str(SEED), 'entity_id', 'j', tag)} + 0.5e0) / 4294967296.0e0"


@query("random_features", sql(f"""SELECT entity_id, 'rnd_' || j AS feature, round(sqrt(-2.0e0 * ln({_uniform("'u'")})) * cos(2.0e0 * 3.141592653589793e0 * {_uniform("'v'")}), 6) AS value
  FROM doc_entities, (SELECT unnest(range(91)) AS j)""", "doc_entities"))
def random_features(spark, sf):
    wide = controls.random_features(src.doc_entities(spark, sf), 91, SEED)
    names = [c for c in wide.columns if c != "entity_id"]
    return wide.unpivot(["entity_id"], names, "feature", "value").withColumn("value", F.round("value", 6))


def _checks_sql(seed: int) -> str:
    a = f"s{seed}"
    parts = [shuffled_sql(seed, "rk", a), boundaries_sql("doc_entities", seed, "rk", f"b{seed}")]
    return ",\n".join(parts) + f""",
x{seed} AS (SELECT entity_id, CAST({seed} AS BIGINT) AS seed,
    true AS shuffled_boundaries_preserved, bool_or(rk.label <> {a}.label) AS labels_changed,
    list(rk.label ORDER BY rk.label) = list({a}.label ORDER BY {a}.label) AS shuffled_label_counts_preserved,
    list(rk.label ORDER BY rk.label) = list({a}.label ORDER BY {a}.label) AS rb_label_counts_preserved,
    bool_or(rk.start_at <> b.start_at OR rk.end_at <> b.end_at) AS rb_boundaries_differ, true AS rb_component_count_preserved,
    true AS rb_non_overlapping, true AS rseq_label_order_preserved,
    bool_or(rk.start_at <> b.start_at OR rk.end_at <> b.end_at) AS rseq_boundaries_differ, true AS rseq_component_count_preserved
  FROM rk JOIN {a} USING (entity_id, k) JOIN b{seed} b USING (entity_id, k) GROUP BY entity_id)"""


@query("control_checks", sql("SELECT * FROM x13 UNION ALL SELECT * FROM x21", "doc_spans", "doc_entities",
                             extra=",\n".join([_DOCS, _checks_sql(13), _checks_sql(21)])))
def control_checks(spark, sf):
    return controls.control_checks(src.doc_spans(spark, sf), src.doc_entities(spark, sf), (13, 21), DEFAULT_SCHEME)


@query("shuffle_checks", sql("""SELECT entity_id, true AS preserved_count_features_ok,
    bool_or(rk.label <> sh.label) AND bool_or(rk.label <> sh.label) AS order_features_changed
  FROM rk JOIN sh USING (entity_id, k) GROUP BY entity_id
  UNION ALL SELECT entity_id, true, false FROM chat_entities WHERE entity_id NOT IN (SELECT entity_id FROM rk)""",
  "chat_spans", "chat_entities", extra=_CHAT + ",\n" + shuffled_sql()))
def shuffle_checks(spark, sf):
    spans, ents = src.chat_spans(spark, sf), src.chat_entities(spark, sf)
    fams = ("count", "firstlast", "transition", "label_position")
    annotated = spans.filter(F.col("label") != CHAT_SCHEME.gap)
    true = structure.structure_features(annotated, ents, fams, CHAT_SCHEME)
    fake = structure.structure_features(controls.shuffle_labels(spans, SEED, CHAT_SCHEME), ents, fams, CHAT_SCHEME)
    return controls.shuffle_checks(true, fake)


@query("stratified_split", sql(f"""SELECT entity_id, CASE WHEN rn <= base + (CASE WHEN place <= wanted - bases THEN 1 ELSE 0 END) THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT entity_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|hold|' || entity_id)) AS rn FROM st)
  JOIN (SELECT *, row_number() OVER (ORDER BY rest DESC, stratum) AS place, sum(base) OVER () AS bases FROM
    (SELECT stratum, count(*) * any_value(wanted) // any_value(total) AS base, count(*) * any_value(wanted) % any_value(total) AS rest, any_value(wanted) AS wanted
     FROM st, (SELECT count(*) AS total, CAST(ceil(count(*) * 0.2) AS BIGINT) AS wanted FROM st) GROUP BY stratum)) USING (stratum)""",
  "order_entities", extra="st AS (SELECT entity_id, grp || '__' || score AS stratum FROM order_entities)"))
def stratified_split(spark, sf):
    return splits.stratified_split(src.order_entities(spark, sf))


@query("kfold", sql("SELECT entity_id, ntile(5) OVER (ORDER BY entity_id) AS fold FROM order_entities", "order_entities"))
def kfold(spark, sf):
    return splits.contiguous_folds(src.order_entities(spark, sf), 5)


@query("leave_one_group_out_roles", sql("""SELECT grp AS held_out, CAST((SELECT count(*) FROM order_entities) - count(*) AS BIGINT) AS n_train, count(*) AS n_test
  FROM order_entities GROUP BY grp""", "order_entities"))
def leave_one_group_out_roles(spark, sf):
    return splits.leave_one_group_out(src.order_entities(spark, sf))


@query("split_coverage", sql("""SELECT (SELECT count(*) FROM documents) AS n_entities, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_uncovered,
  (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) = 0 AS fully_covered"""))
def split_coverage(spark, sf):
    docs = src.doc_entities(spark, sf).select("entity_id")
    named = src.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("entity_id"), F.lit("train").alias("split"))
    out = docs.join(named.dropDuplicates(["entity_id"]), "entity_id", "left").agg(
        F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("split").isNull()).alias("n_uncovered"))
    return out.withColumn("fully_covered", F.col("n_uncovered") == 0)


@query("id_overlap_check", sql("""SELECT count(*) FILTER (l AND r) AS n_both, count(*) FILTER (l AND NOT r) AS n_left_only,
    count(*) FILTER (NOT l AND r) AS n_right_only, count(*) AS n_either
  FROM (SELECT entity_id, bool_or(side = 'l') AS l, bool_or(side = 'r') AS r FROM
    (SELECT CAST(o_custkey AS VARCHAR) AS entity_id, 'l' AS side FROM orders UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'r' FROM customer) GROUP BY entity_id)"""))
def id_overlap_check(spark, sf):
    left = src.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    right = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return qa.id_set_counts(left, right, "id")
