"""Ordered-span feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spandoc.catalog.ctes import sql
from spandoc.catalog.feature_sql import features_body, features_extra
from spandoc.catalog.registry import query
from spandoc.operators import exemplars, structure
from spandoc.operators.audit import structure_statistics
from spandoc.plans import conditions
from spandoc.schemas import CHAT_SCHEME, DEFAULT_SCHEME, EVENT_SCHEME, FLAG_SCHEME
from spandoc.sources import adapters as src

SOURCES = {
    "chat": (src.chat_spans, src.chat_entities, CHAT_SCHEME, "chat_spans", "chat_entities"),
    "docs": (src.doc_spans, src.doc_entities, DEFAULT_SCHEME, "doc_spans", "doc_entities"),
}
_RANKS = "(SELECT max(c) FROM (SELECT count(*) AS c FROM {spans} JOIN {ents} USING (entity_id) WHERE split = 'train' AND label <> '{gap}' GROUP BY entity_id))"


def family_sql(source: str, families) -> str:
    _, _, scheme, spans, ents = SOURCES[source]
    ranks = _RANKS.format(spans=spans, ents=ents, gap=scheme.gap)
    return sql(features_body(families, scheme.labels, scheme.gap, ranks), spans, ents,
               extra=features_extra(spans, ents, scheme.labels, scheme.gap))


def family_query(source: str, families):
    def run(spark, sf):
        spans_of, ents_of, scheme, _, _ = SOURCES[source]
        spans, ents = spans_of(spark, sf), ents_of(spark, sf)
        rows = structure.unpivot_features(structure.structure_features(spans, ents, tuple(families), scheme), 6)
        if {"geometry", "boundary_only"} & set(families):
            ranks = structure.max_rank_count(spans, ents.filter("split = 'train'"), scheme)
            slots = structure.slot_rows(spans, ents, scheme, ranks)
            rows = rows.unionByName(slots.withColumn("value", F.round("value", 6)).filter("value <> 0"))
        return rows

    return run


for _name, _source, _families in (
    ("structure_features", "chat", ("count", "firstlast", "transition")),
    ("count_features", "docs", ("count",)),
    ("first_last_onehot", "docs", ("firstlast",)),
    ("label_positions", "chat", ("label_position",)),
    ("label_positions_docs", "docs", ("label_position",)),
    ("boundary_geometry", "chat", ("geometry",)),
    ("boundary_only", "docs", ("boundary_only",)),
    ("surface_features", "docs", ("surface",)),
):
    query(_name, family_sql(_source, _families))(family_query(_source, _families))


@query("transitions_window", sql("""SELECT entity_id, label AS from_label, nl AS to_label, count(*) AS n,
  round(count(*) / CAST(any_value(c) - 1 AS DOUBLE), 9) AS share
  FROM (SELECT *, lead(label) OVER w AS nl, count(*) OVER (PARTITION BY entity_id) AS c FROM event_spans
        WINDOW w AS (PARTITION BY entity_id ORDER BY start_at, end_at, label, k)) WHERE nl IS NOT NULL GROUP BY entity_id, label, nl""",
  "event_spans"))
def transitions_window(spark, sf):
    out = structure.transitions(src.event_spans(spark, sf), EVENT_SCHEME)
    return out.withColumn("share", F.round("share", 9))


_TRANS = sql("""SELECT entity_id, label AS from_label, nl AS to_label, count(*) AS n,
  round(count(*) / CAST(any_value(c) - 1 AS DOUBLE), 9) AS share
  FROM (SELECT *, lead(label) OVER w AS nl, count(*) OVER (PARTITION BY entity_id) AS c FROM doc_spans WHERE label <> 'Unannotated'
        WINDOW w AS (PARTITION BY entity_id ORDER BY start_at, end_at, label, k)) WHERE nl IS NOT NULL GROUP BY entity_id, label, nl""",
  "doc_spans")


@query("transitions_docs", _TRANS)
def transitions_docs(spark, sf):
    return structure.transitions(src.doc_spans(spark, sf)).withColumn("share", F.round("share", 9))


@query("transitions_array", _TRANS)
def transitions_array(spark, sf):
    return structure.transitions_from_lists(src.doc_spans(spark, sf)).withColumn("share", F.round("share", 9))


@query("transitions_order_lines", sql("""SELECT entity_id, label AS from_label, nl AS to_label, count(*) AS n,
  round(count(*) / CAST(any_value(c) - 1 AS DOUBLE), 9) AS share
  FROM (SELECT *, lead(label) OVER w AS nl, count(*) OVER (PARTITION BY entity_id) AS c FROM order_line_spans
        WINDOW w AS (PARTITION BY entity_id ORDER BY start_at, end_at, label, k)) WHERE nl IS NOT NULL GROUP BY entity_id, label, nl""",
  "order_line_spans"))
def transitions_order_lines(spark, sf):
    out = structure.transitions(src.order_line_spans(spark, sf), FLAG_SCHEME)
    return out.withColumn("share", F.round("share", 9))


@query("rank_slots", sql("""SELECT entity_id, rk - 1 AS rank, round(start_at / n, 9) AS start_share, round((end_at + 1) / n, 9) AS end_share
  FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY start_at, end_at, label, k) AS rk FROM doc_spans WHERE label <> 'Unannotated')
  JOIN (SELECT entity_id, CAST(greatest(char_count, 1) AS DOUBLE) AS n FROM doc_entities) USING (entity_id)""", "doc_spans", "doc_entities"))
def rank_slots(spark, sf):
    out = structure.rank_slots(src.doc_spans(spark, sf), src.doc_entities(spark, sf))
    return out.select("entity_id", "rank", F.round("start_share", 9).alias("start_share"), F.round("end_share", 9).alias("end_share"))


@query("structure_by_entity", sql("""SELECT s.entity_id, count(*) FILTER (label <> 'system') AS component_count,
    count(DISTINCT label) FILTER (label <> 'system') AS label_diversity, bool_or(label = 'user') AS has_user, bool_or(label = 'assistant') AS has_assistant,
    any_value(score) AS score, any_value(grp) AS grp, any_value(subgrp) AS subgrp, any_value(char_count) AS char_count,
    round(sum(end_at - start_at + 1) / CAST(any_value(char_count) AS DOUBLE) * 100, 4) AS coverage_pct
  FROM chat_spans s JOIN chat_entities e USING (entity_id) GROUP BY s.entity_id""", "chat_spans", "chat_entities"))
def structure_by_entity(spark, sf):
    return structure_statistics(src.chat_entities(spark, sf), src.chat_spans(spark, sf), scheme=CHAT_SCHEME)


_COND = ("surface", "count", "firstlast", "transition", "label_position", "geometry")


def _condition_rows(spark, sf, name):
    rows = conditions.condition_rows(name, src.doc_spans(spark, sf), src.doc_entities(spark, sf))
    return rows.withColumn("value", F.round("value", 6)).filter("value <> 0")


@query("condition_matrix", family_sql("docs", _COND))
def condition_matrix(spark, sf):
    return _condition_rows(spark, sf, "T3_PLUS_POS")


@query("condition_pos_trans", family_sql("docs", ("surface", "count", "geometry", "transition")))
def condition_pos_trans(spark, sf):
    return _condition_rows(spark, sf, "POS_TRANS")


@query("condition_boundary_only", family_sql("docs", ("surface", "count", "boundary_only")))
def condition_boundary_only(spark, sf):
    return _condition_rows(spark, sf, "BOUNDARY_ONLY")


@query("condition_counts_trans", family_sql("docs", ("surface", "count", "transition")))
def condition_counts_trans(spark, sf):
    wide = conditions.build_condition("COUNTS_TRANS", src.doc_spans(spark, sf), src.doc_entities(spark, sf))
    return structure.unpivot_features(wide, 6)


@query("condition_no_trans", family_sql("docs", ("surface", "count", "firstlast", "label_position")))
def condition_no_trans(spark, sf):
    wide = conditions.build_condition("NO_TRANS", src.doc_spans(spark, sf), src.doc_entities(spark, sf))
    return structure.unpivot_features(wide, 6)


_EXEMPLAR_SQL = r"""base AS (
  SELECT e.entity_id, score, e.grp, e.subgrp, char_count, coalesce(n_ann, 0) AS n_ann, coalesce(ov, 0) AS ov,
    CASE WHEN char_count = 0 THEN 'missing_text' WHEN smin IS NULL THEN 'no_spans' WHEN smin <> 0 THEN 'does_not_start_at_zero'
      WHEN emax <> char_count - 1 THEN 'does_not_end_at_last_char' WHEN br > 0 THEN 'gap_or_overlap' ELSE 'complete_partition' END AS partition_status
  FROM doc_entities e LEFT JOIN (
    SELECT entity_id, count(*) FILTER (label <> 'Unannotated') AS n_ann, min(start_at) AS smin, max(end_at) AS emax,
      count(*) FILTER (end_at + 1 <> nx) AS br, count(*) FILTER (label <> 'Unannotated' AND end_at >= nxa) AS ov
    FROM (SELECT *, lead(start_at) OVER (PARTITION BY entity_id ORDER BY start_at, end_at, label, k) AS nx,
        lead(start_at) OVER (PARTITION BY entity_id, label = 'Unannotated' ORDER BY start_at, end_at, label, k) AS nxa FROM audited)
    GROUP BY entity_id) USING (entity_id)),
cand AS (
  SELECT entity_id, 1 AS pri, 'score=' || score AS stratum, 1 AS take FROM base WHERE score BETWEEN 1 AND 6
  UNION ALL SELECT entity_id, 2, 'grp=' || grp, 1 FROM base WHERE grp IN (SELECT DISTINCT grp FROM base ORDER BY grp LIMIT 8)
  UNION ALL SELECT entity_id, 3, 'subgrp=' || subgrp, 2 FROM base
  UNION ALL SELECT entity_id, 4, 'complex', 3 FROM base WHERE n_ann >= 8
  UNION ALL SELECT entity_id, 5, 'simple', 2 FROM base WHERE n_ann <= 4
  UNION ALL SELECT entity_id, 6, 'bad_partition', 3 FROM base WHERE partition_status <> 'complete_partition'
  UNION ALL SELECT entity_id, 7, 'overlapping', 2 FROM base WHERE ov > 0
  UNION ALL SELECT entity_id, 8, 'fill', 20 FROM base WHERE n_ann > 0),
strata AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY pri, stratum) AS n, pri, stratum, any_value(take) AS take, list(entity_id ORDER BY entity_id) AS ids
  FROM cand GROUP BY pri, stratum),
fold AS (
  SELECT 0::BIGINT AS n, CAST([] AS STRUCT(entity_id VARCHAR, pri INTEGER, stratum VARCHAR)[]) AS log
  UNION ALL
  SELECT n + 1, list_concat(log, list_transform(pick, lambda x: {'entity_id': x, 'pri': pri, 'stratum': stratum}))
  FROM (SELECT f.n, f.log, s.pri, s.stratum,
      CASE WHEN s.pri <= 3 THEN list_filter(s.ids, lambda x: NOT list_contains(list_transform(f.log, lambda p: p.entity_id), x))[1:s.take]
        WHEN s.pri < 8 THEN list_filter(s.ids[1:s.take], lambda x: NOT list_contains(list_transform(f.log, lambda p: p.entity_id), x))
        ELSE list_filter(s.ids, lambda x: NOT list_contains(list_transform(f.log, lambda p: p.entity_id), x))[1:greatest(0, 20 - len(f.log))]
      END AS pick
    FROM fold f JOIN strata s ON s.n = f.n + 1)),
sel AS (SELECT p.entity_id, p.pri, p.stratum FROM (SELECT unnest(log) AS p FROM (SELECT log FROM fold ORDER BY n DESC LIMIT 1)))"""


@query("exemplars", sql("SELECT entity_id, pri AS priority, stratum FROM sel", "doc_entities", "audited", extra=_EXEMPLAR_SQL, recursive=True))
def exemplar_ids(spark, sf):
    ents, spans = src.doc_entities(spark, sf), src.audited_spans(spark, sf)
    issues = exemplars.issue_columns(spans, ents)
    return exemplars.select_exemplars(ents, issues, valid=issues.filter("annotated_segments > 0"))


@query("exemplar_details", sql("""SELECT entity_id, pri AS priority, stratum, rk AS position, label, start_at, end_at,
    CASE WHEN char_count = 0 THEN '0.00–0.00' ELSE printf('%.2f', start_at / CAST(char_count AS DOUBLE)) || '–' || printf('%.2f', (end_at + 1) / CAST(char_count AS DOUBLE)) END AS relative_range,
    replace(substr(coalesce(span_text, ''), 1, 120), chr(10), ' ') || CASE WHEN length(coalesce(span_text, '')) > 120 THEN '...' ELSE '' END AS preview,
    string_agg(label, ' → ') OVER (PARTITION BY entity_id ORDER BY start_at, end_at, label, k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS label_path,
    score, partition_status, overlap_pairs, effectiveness
  FROM (SELECT a.*, sel.pri, sel.stratum, e.char_count, e.score, e.partition_status, e.ov AS overlap_pairs, x.effectiveness, row_number() OVER (PARTITION BY a.entity_id ORDER BY start_at, end_at, label, k) AS rk
        FROM audited a JOIN sel USING (entity_id) JOIN base e USING (entity_id) LEFT JOIN (SELECT entity_id AS xe, row_no, effectiveness FROM annot) x ON xe = a.entity_id AND row_no = a.k
        WHERE a.label <> 'Unannotated')""", "doc_entities", "audited", "annot", extra=_EXEMPLAR_SQL, recursive=True))
def exemplar_details(spark, sf):
    ents, spans = src.doc_entities(spark, sf), src.audited_spans(spark, sf, True)
    rated = src.annotation_rows(spark, sf).select("entity_id", F.col("row_no").alias("k"), "effectiveness")
    selected = exemplar_ids(spark, sf)
    spans = spans.join(F.broadcast(selected.select("entity_id")), "entity_id").join(rated, ["entity_id", "k"], "left")
    return exemplars.render(selected, spans, ents, issues=exemplars.issue_columns(src.audited_spans(spark, sf), ents))
