"""Audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spandoc.catalog.ctes import h, sql
from spandoc.catalog.registry import query
from spandoc.operators import audit, geometry
from spandoc.plans.storage import shared_folder
from spandoc.schemas import ANNOTATION_SCHEMA, CHAT_SCHEME, DEFAULT_SCHEME, EVENT_SCHEME, FLAG_SCHEME
from spandoc.sources import adapters as src, tables

_NULLS = ["doc_id", "lang", "quality"]
_PROFILE_ROWS = """d AS (SELECT * FROM (SELECT 'documents' AS source, doc_id, lang, CAST(NULL AS INTEGER) AS quality FROM documents
  UNION ALL SELECT 'labels', doc_id, NULL, quality FROM labels
  UNION ALL SELECT 'labels_again', doc_id, NULL, quality FROM labels WHERE toxic = 1))"""


@query("profile_nulls", sql(f"""
SELECT source, count(*) AS row_count, count(DISTINCT doc_id) AS entity_count,
       count(*) - count(DISTINCT (doc_id, lang, quality)) AS duplicate_row_count,
       count(*) FILTER (doc_id IS NULL) AS null_doc_id, count(*) FILTER (lang IS NULL) AS null_lang,
       count(*) FILTER (quality IS NULL) AS null_quality, CAST(3 AS BIGINT) AS column_count,
       CASE WHEN count(*) > count(DISTINCT doc_id) THEN 'one row per span' ELSE 'one row per entity' END AS row_unit,
       '{{"doc_id":' || count(*) FILTER (doc_id IS NULL) || ',"lang":' || count(*) FILTER (lang IS NULL)
       || ',"quality":' || count(*) FILTER (quality IS NULL) || '}}' AS missing_values_json
FROM (SELECT * FROM d UNION ALL SELECT 'combined', doc_id, lang, quality FROM d) GROUP BY source""",
    extra=_PROFILE_ROWS))
def profile_nulls(spark, sf):
    docs = src.table(spark, sf, "documents").select("doc_id", "lang")
    labels = src.table(spark, sf, "labels")
    named = {"documents": docs, "labels": labels.select("doc_id", "quality"),
             "labels_again": labels.filter("toxic = 1").select("doc_id", "quality")}
    return audit.missing_as_json(audit.profile(named, "doc_id", _NULLS), _NULLS)


@query("profile_events", sql("""
SELECT 'events' AS source, count(*) AS row_count, count(DISTINCT user_id) AS entity_count,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events)) AS duplicate_row_count,
       count(*) FILTER (value IS NULL) AS null_value, count(*) FILTER (props IS NULL) AS null_props,
       CAST(6 AS BIGINT) AS column_count, 'one row per span' AS row_unit FROM events
UNION ALL
SELECT 'combined', count(*), count(DISTINCT user_id),
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events)),
       count(*) FILTER (value IS NULL), count(*) FILTER (props IS NULL), 6, 'one row per span' FROM events"""))
def profile_events(spark, sf):
    return audit.profile({"events": src.table(spark, sf, "events")}, "user_id", ["value", "props"])


_ENTITIES = """ents AS (
  SELECT entity_id,
    arg_min(text, source_file || lpad(CAST(row_no AS VARCHAR), 12, '0')) FILTER (text IS NOT NULL) AS text,
    arg_min(score, row_no) FILTER (score IS NOT NULL) AS score,
    arg_min(grp, row_no) FILTER (grp IS NOT NULL) AS grp,
    arg_min(subgrp, row_no) FILTER (subgrp IS NOT NULL) AS subgrp,
    arg_min(grade, row_no) FILTER (grade IS NOT NULL) AS grade,
    arg_min(word_count_field, row_no) FILTER (word_count_field IS NOT NULL) AS word_count_field,
    string_agg(DISTINCT split, '|' ORDER BY split) AS split,
    string_agg(DISTINCT source_file, '|' ORDER BY source_file) AS source_files,
    count(*) AS annotation_count, count(*) FILTER (label <> 'Unannotated') AS annotated_component_count,
    coalesce(bool_or(label <> 'Unannotated' AND effectiveness IS NOT NULL), false) AS has_effectiveness_labels,
    count(DISTINCT text) AS text_variant_count, count(DISTINCT score) AS score_variant_count
  FROM annot GROUP BY entity_id)"""
_VALID = """flags AS (
  SELECT *, coalesce(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '') <> '' AS has_full_text, score IS NOT NULL AS has_holistic_score,
         coalesce(trim(grp), '') <> '' AS has_prompt, annotated_component_count > 0 AS has_discourse_annotations
  FROM ents),
jv AS (
  SELECT *, exclusion_reason = '' AS join_valid FROM (
    SELECT *, concat_ws(';', CASE WHEN text_variant_count > 1 THEN 'conflicting_full_text' END,
      CASE WHEN score_variant_count > 1 THEN 'conflicting_holistic_score' END,
      CASE WHEN NOT has_full_text THEN 'missing_full_text' END,
      CASE WHEN NOT has_holistic_score THEN 'missing_holistic_score' END,
      CASE WHEN NOT has_prompt THEN 'missing_prompt' END,
      CASE WHEN NOT has_discourse_annotations THEN 'no_discourse_annotations' END,
      CASE WHEN split LIKE '%|%' THEN 'essay_in_multiple_splits' END) AS exclusion_reason FROM flags))"""


@query("entity_consolidation", sql("SELECT * FROM ents", "annot", extra=_ENTITIES))
def entity_consolidation(spark, sf):
    return audit.consolidate(src.annotation_rows(spark, sf))


@query("join_validation", sql("""SELECT entity_id, has_full_text, has_holistic_score, has_prompt,
  has_discourse_annotations, has_effectiveness_labels, annotation_count, annotated_component_count, join_valid,
  exclusion_reason, split, grp, score FROM jv""", "annot", extra=_ENTITIES + ",\n" + _VALID))
def join_validation(spark, sf):
    return audit.validate_entities(entity_consolidation(spark, sf))


@query("valid_train_entities", sql("SELECT entity_id, score, split FROM jv WHERE join_valid AND split = 'train'",
                                   "annot", extra=_ENTITIES + ",\n" + _VALID))
def valid_train_entities(spark, sf):
    ents = entity_consolidation(spark, sf)
    return tables.valid_entities(ents, audit.validate_entities(ents), "train").select("entity_id", "score", "split")


@query("reloaded_valid_entities", sql("SELECT entity_id, score, split FROM jv WHERE join_valid AND split = 'train'",
                                      "annot", extra=_ENTITIES + ",\n" + _VALID))
def reloaded_valid_entities(spark, sf):
    """The same from saved tables: entities as Parquet, their validation partitioned by its outcome."""
    folder = shared_folder(spark)
    ents = entity_consolidation(spark, sf)
    tables.save(ents, f"{folder}/entities")
    saved = tables.load(spark, f"{folder}/entities", schema=ents.schema)
    checked = audit.validate_entities(saved)
    tables.save(checked, f"{folder}/validation", partition_by=["join_valid"])
    checked = tables.load(spark, f"{folder}/validation", schema=checked.schema)
    return tables.valid_entities(saved, checked, "train").select("entity_id", "score", "split")


@query("annotation_csv", sql("""SELECT entity_id, label, count(*) AS n_rows, sum(start_at)::BIGINT AS starts, sum(end_at)::BIGINT AS ends,
  sum(length(text))::BIGINT AS chars, count(score) AS n_scores FROM annot GROUP BY entity_id, label""", "annot"))
def annotation_csv(spark, sf):
    """Annotation rows written as raw CSV files (texts with line breaks and quotes) and read back through their schema.

    Every row repeats the text of its entity, so the files are compressed; with line breaks in texts they are not cut anyway.
    """
    rows = src.annotation_rows(spark, sf)
    raw = {"essay_id": "entity_id", "full_text": "text", "holistic_essay_score": "score", "discourse_start": "start_at",
           "discourse_end": "end_at", "discourse_type": "label"}
    path = shared_folder(spark)
    tables.save(rows.select(*[
        (F.col(raw[f.name]) if f.name in raw else F.lit(None)).cast(f.dataType).alias(f.name) for f in ANNOTATION_SCHEMA]), path, "csv", compression="gzip")
    back = tables.read_annotations(spark, [path])
    spans = tables.spans_of(back.withColumn("essay_id", F.struct("essay_id", "full_text", "holistic_essay_score")))
    return spans.groupBy(F.col("entity_id.essay_id").alias("entity_id"), "label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("start_at").alias("starts"), F.sum("end_at").alias("ends"),
        F.sum(F.length("entity_id.full_text")).alias("chars"), F.count("entity_id.holistic_essay_score").alias("n_scores"))


@query("restricted_span_scan", sql("""SELECT s.entity_id, start_at, end_at, label, k, 'chat' AS _source_file
  FROM chat_spans s WHERE entity_id IN (SELECT entity_id FROM chat_entities WHERE split = 'train')
  UNION ALL SELECT entity_id, start_at, end_at, label, k, 'docs' FROM doc_spans
  WHERE entity_id IN (SELECT entity_id FROM chat_entities WHERE split = 'train')""",
  "chat_spans", "chat_entities", "doc_spans"))
def restricted_span_scan(spark, sf):
    ids = src.chat_entities(spark, sf).filter("split = 'train'")
    return tables.scan_spans({"chat": src.chat_spans(spark, sf), "docs": src.doc_spans(spark, sf)}, ids)


@query("ordered_span_lists", sql("""SELECT entity_id, string_agg(start_at || ':' || end_at || ':' || label, ','
  ORDER BY start_at, end_at, label, k) AS span_list, count(*) AS n_spans FROM doc_spans GROUP BY entity_id""", "doc_spans"))
def ordered_span_lists(spark, sf):
    lists = tables.span_lists(src.doc_spans(spark, sf))
    cell = F.transform("spans", lambda s: F.concat_ws(":", s["start_at"].cast("string"), s["end_at"].cast("string"), s["label"]))
    return lists.select("entity_id", F.array_join(cell, ",").alias("span_list"),
                        F.size("spans").cast("bigint").alias("n_spans"))


_SLICE = """sl AS (
  SELECT a.entity_id, k, start_at, end_at, label, length(t.text) AS n, coalesce(span_text, '') AS q,
         CASE WHEN start_at >= 0 AND end_at >= start_at THEN substr(t.text, start_at + 1, end_at - start_at + 1) END AS inc,
         CASE WHEN start_at >= 0 AND end_at >= start_at THEN substr(t.text, start_at + 1, end_at - start_at) END AS exc
  FROM audited a JOIN doc_entities t USING (entity_id) WHERE label <> 'Unannotated'),
st AS (
  SELECT entity_id, k, start_at, end_at, n AS text_length, CASE
    WHEN start_at < 0 OR end_at < start_at THEN 'invalid_span' WHEN end_at >= n THEN 'outside_boundary'
    WHEN inc = q THEN 'exact_inclusive' WHEN exc = q THEN 'exact_exclusive'
    WHEN regexp_replace(inc, '^\\s+|\\s+$', '', 'g') = regexp_replace(q, '^\\s+|\\s+$', '', 'g') THEN 'strip_match_inclusive'
    WHEN regexp_replace(exc, '^\\s+|\\s+$', '', 'g') = regexp_replace(q, '^\\s+|\\s+$', '', 'g') THEN 'strip_match_exclusive'
    WHEN q <> '' AND contains(inc, q) THEN 'discourse_text_trimmed' ELSE 'mismatch' END AS status FROM sl)"""


@query("span_text_match", sql("SELECT status, count(*) AS n_spans FROM st GROUP BY status",
                              "audited", "doc_entities", extra=_SLICE))
def span_text_match(spark, sf):
    return audit.match_histogram(src.audited_spans(spark, sf, True), src.doc_entities(spark, sf))


@query("span_text_status", sql("SELECT entity_id, k, start_at, end_at, text_length, status FROM st",
                               "audited", "doc_entities", extra=_SLICE))
def span_text_status(spark, sf):
    return audit.match_statuses(src.audited_spans(spark, sf, True), src.doc_entities(spark, sf))


@query("span_text_match_sampled", sql(f"""SELECT status, CAST(floor(count(*) / 0.5) AS BIGINT) AS n_spans FROM st
  WHERE status <> 'outside_boundary' AND {h("42", "'sample'", "entity_id", "k")} < 2147483648 GROUP BY status
  UNION ALL SELECT 'outside_boundary', count(*) FILTER (end_at >= text_length) FROM st""", "audited", "doc_entities", extra=_SLICE))
def span_text_match_sampled(spark, sf):
    return audit.match_histogram(src.audited_spans(spark, sf, True), src.doc_entities(spark, sf), fraction=0.5)


@query("label_counts_with_nulls", sql("""SELECT label AS value, 'label' AS col, count(*) AS n FROM annot GROUP BY 1
  UNION ALL SELECT effectiveness, 'effectiveness', count(*) FROM annot GROUP BY 1""", "annot"))
def label_counts_with_nulls(spark, sf):
    rows = src.annotation_rows(spark, sf)
    a = audit.value_counts(rows, "label").select(F.col("label").alias("value"), F.lit("label").alias("col"), "n")
    b = audit.value_counts(rows, "effectiveness").select(
        F.col("effectiveness").alias("value"), F.lit("effectiveness").alias("col"), "n")
    return a.unionByName(b)


@query("label_set_check", sql("""SELECT coalesce((SELECT string_agg(DISTINCT label, '|' ORDER BY label) FROM order_line_spans
    WHERE label NOT IN ('A', 'B', 'R')), '') AS unexpected,
  coalesce((SELECT string_agg(x, '|' ORDER BY x) FROM (VALUES ('A'), ('B'), ('R')) v(x)
    WHERE x NOT IN (SELECT label FROM order_line_spans)), '') AS missing""", "order_line_spans"))
def label_set_check(spark, sf):
    from spandoc.schemas import LabelScheme

    return audit.label_set_check(src.order_line_spans(spark, sf), LabelScheme(labels=("A", "B", "R"), gap="none"))


@query("segment_stats", sql("""SELECT s.entity_id, count(*) AS total_segments, count(*) FILTER (label = 'system') AS unannotated_segments,
  min(start_at) AS start_min, max(end_at) AS end_max, any_value(char_count) AS text_length,
  count(*) FILTER (label <> 'system') AS annotated_segments
  FROM chat_spans s JOIN chat_entities e USING (entity_id) GROUP BY s.entity_id""", "chat_spans", "chat_entities"))
def segment_stats(spark, sf):
    return geometry.segment_stats(src.chat_spans(spark, sf), src.chat_entities(spark, sf), CHAT_SCHEME)


_STATS = """stats AS (
  SELECT e.entity_id, any_value(e.score) AS score, any_value(e.grp) AS grp, any_value(e.subgrp) AS subgrp,
    any_value(char_count) AS char_count, CAST(len(regexp_extract_all(any_value(e.text), '[\\p{L}\\p{N}_]+')) AS BIGINT) AS word_count,
    count(*) FILTER (label <> 'Unannotated') AS component_count,
    count(DISTINCT label) FILTER (label <> 'Unannotated') AS label_diversity,
    round(CAST(sum(end_at - start_at + 1) AS DOUBLE) / nullif(any_value(char_count), 0) * 100, 4) AS coverage_pct,
    coalesce(bool_or(label = 'Lead'), false) AS has_lead, coalesce(bool_or(label = 'Position'), false) AS has_position,
    coalesce(bool_or(label = 'Claim'), false) AS has_claim,
    coalesce(bool_or(label = 'Counterclaim'), false) AS has_counterclaim, coalesce(bool_or(label = 'Rebuttal'), false) AS has_rebuttal,
    coalesce(bool_or(label = 'Evidence'), false) AS has_evidence,
    coalesce(bool_or(label = 'Concluding Statement'), false) AS has_concluding_statement
  FROM doc_entities e LEFT JOIN audited a ON a.entity_id = e.entity_id GROUP BY e.entity_id)"""


@query("structure_stats", sql("SELECT stats.*, join_valid FROM stats LEFT JOIN jv USING (entity_id)", "doc_entities", "annot",
                              extra=_STATS + ",\n" + _ENTITIES + ",\n" + _VALID))
def structure_stats(spark, sf):
    return audit.structure_statistics(src.doc_entities(spark, sf), src.audited_spans(spark, sf), join_validation(spark, sf))


@query("structure_by_score", sql("""SELECT score, count(*) AS entities, round(avg(word_count), 6) AS mean_word_count,
  round(avg(component_count), 6) AS mean_components, round(avg(CAST(has_claim AS INT)), 6) AS pct_claim,
  round(avg(CAST(has_evidence AS INT)), 6) AS pct_evidence
  FROM stats JOIN jv USING (entity_id) WHERE join_valid GROUP BY stats.score""".replace("SELECT score", "SELECT stats.score"),
  "doc_entities", "annot", extra=_STATS + ",\n" + _ENTITIES + ",\n" + _VALID))
def structure_by_score(spark, sf):
    out = audit.structure_by_score(structure_stats(spark, sf), ["has_claim", "has_evidence"])
    return out.select("score", "entities", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query("audit_summary", sql("""SELECT *, CASE
    WHEN valid / total >= 0.95 AND complete / total >= 0.95 AND NOT (conflicting_text > 0 OR multi_split > 0 OR outside > 0) THEN 'PROCEED'
    WHEN (valid / total >= 0.95 AND complete / total >= 0.95) OR valid / total >= 0.85 THEN 'PROCEED WITH EXCLUSIONS'
    ELSE 'DO NOT PROCEED' END AS classification
  FROM (SELECT count(*) AS total, count(*) FILTER (join_valid) AS valid,
    count(*) FILTER (has_full_text AND has_holistic_score AND has_discourse_annotations) AS complete,
    count(*) FILTER (split LIKE '%|%') AS multi_split, count(*) FILTER (text_variant_count > 1) AS conflicting_text,
    (SELECT count(*) FROM st WHERE end_at >= text_length) AS outside FROM jv)""",
  "annot", "doc_entities", extra=_ENTITIES + ",\n" + _VALID + ",\n" + _SLICE))
def audit_summary(spark, sf):
    ents = entity_consolidation(spark, sf)
    return audit.audit_summary(audit.validate_entities(ents), ents, span_text_status(spark, sf))


@query("top_exclusion_reasons", sql("""SELECT exclusion_reason, count(*) AS n FROM jv WHERE NOT join_valid
  GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5""", "annot", extra=_ENTITIES + ",\n" + _VALID))
def top_exclusion_reasons(spark, sf):
    return audit.top_reasons(join_validation(spark, sf))


@query("duplicate_spans", sql("""SELECT entity_id, count(*) AS duplicate_annotations FROM
  (SELECT entity_id, start_at, label FROM (SELECT entity_id, start_at - start_at % 30 AS start_at, label FROM order_line_spans)
   GROUP BY entity_id, start_at, label HAVING count(*) > 1) GROUP BY entity_id""", "order_line_spans"))
def duplicate_spans(spark, sf):
    month = (F.col("start_at") - F.col("start_at") % 30).alias("start_at")
    spans = src.order_line_spans(spark, sf).select("entity_id", "k", month, F.lit(0).alias("end_at"), "label")
    return geometry.duplicate_spans(spans, FLAG_SCHEME)


@query("score_distribution", sql("""SELECT score, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 4) AS percentage
  FROM order_entities GROUP BY score""", "order_entities"))
def score_distribution(spark, sf):
    return audit.score_distribution(src.order_entities(spark, sf))


@query("group_score_counts", sql("""SELECT 'grp' AS level, grp AS name, score, count(*) AS n FROM order_entities GROUP BY ALL
  UNION ALL SELECT 'subgrp', subgrp, score, count(*) FROM order_entities GROUP BY ALL""", "order_entities"))
def group_score_counts(spark, sf):
    return audit.group_score_counts(src.order_entities(spark, sf))


@query("group_inventory", sql("""SELECT e.*, j.score_distribution_json FROM
  (SELECT grp, count(*) AS entity_count, string_agg(DISTINCT subgrp, '|' ORDER BY subgrp) AS subgroups,
    count(*) FILTER (subgrp = 'en') AS count_en, count(*) FILTER (subgrp = 'de') AS count_de, count(*) FILTER (subgrp = 'es') AS count_es, count(*) FILTER (subgrp = 'fr') AS count_fr,
    (SELECT coalesce(string_agg(CAST(g AS VARCHAR), '|' ORDER BY g), '') FROM (SELECT DISTINCT i.grade AS g FROM ents i WHERE i.grp = ents.grp AND i.grade IS NOT NULL)) AS grades,
    min(score) AS score_min, max(score) AS score_max,
    coalesce(string_agg(DISTINCT CAST(CAST(score AS BIGINT) AS VARCHAR), '|' ORDER BY CAST(CAST(score AS BIGINT) AS VARCHAR)), '') AS unique_scores
   FROM ents GROUP BY grp) e
  LEFT JOIN (SELECT grp, '{' || string_agg('"' || CAST(score AS BIGINT) || '":' || n, ',' ORDER BY score) || '}' AS score_distribution_json
   FROM (SELECT grp, score, count(*) AS n FROM ents WHERE score IS NOT NULL GROUP BY grp, score) GROUP BY grp) j
  ON e.grp IS NOT DISTINCT FROM j.grp""", "annot", extra=_ENTITIES))
def group_inventory(spark, sf):
    return audit.group_inventory(entity_consolidation(spark, sf), ["en", "de", "es", "fr"])


_PART = """agg AS (
  SELECT entity_id, min(start_at) AS start_min, max(end_at) AS end_max, arg_max(end_at, rn) AS last_end,
         count(*) FILTER (end_at + 1 <> nx) AS breaks
  FROM (SELECT *, row_number() OVER w AS rn, lead(start_at) OVER w AS nx FROM {t}
        WINDOW w AS (PARTITION BY entity_id ORDER BY start_at, end_at, label, k)) GROUP BY entity_id)"""
_PART_BODY = """SELECT e.entity_id, start_min, end_max, char_count, CASE {first}
  WHEN start_min IS NULL THEN 'no_spans' WHEN start_min <> 0 THEN 'does_not_start_at_zero'
  WHEN {end} <> char_count - 1 THEN 'does_not_end_at_last_char' WHEN breaks > 0 THEN 'gap_or_overlap'
  ELSE 'complete_partition' END AS partition_status FROM doc_entities e LEFT JOIN agg USING (entity_id)"""


@query("partition_status", sql(_PART_BODY.format(first="WHEN char_count = 0 THEN 'missing_text'", end="end_max"),
                               "doc_entities", "audited", extra=_PART.format(t="audited")))
def partition_status(spark, sf):
    return geometry.partition_status(src.audited_spans(spark, sf), src.doc_entities(spark, sf))


@query("partition_status_last_span", sql(_PART_BODY.format(first="", end="last_end"),
                                         "doc_entities", "audited", extra=_PART.format(t="audited")))
def partition_status_last_span(spark, sf):
    return geometry.partition_status(src.audited_spans(spark, sf), src.doc_entities(spark, sf), bounds="last")


@query("overlap_pairs", sql("""SELECT entity_id, count(*) FILTER (end_at >= nx) AS overlap_pairs FROM
  (SELECT *, lead(start_at) OVER (PARTITION BY entity_id ORDER BY start_at, end_at, label, k) AS nx FROM order_line_spans)
  GROUP BY entity_id""", "order_line_spans"))
def overlap_pairs(spark, sf):
    return geometry.overlap_pairs(src.order_line_spans(spark, sf), FLAG_SCHEME)


def _order_sql(table: str, gap: str, lead: str, position: str, claim: str, closing: str) -> str:
    return sql(f"""SELECT entity_id, NOT (
    (len(list_filter(l, lambda x: x = '{lead}')) = 1 AND l[1] <> '{lead}')
    OR (len(list_filter(l, lambda x: x = '{closing}')) = 1 AND l[len(l)] <> '{closing}')
    OR (list_contains(l, '{position}') AND list_contains(l, '{claim}')
        AND list_position(l, '{position}') > list_position(l, '{claim}'))) AS order_valid
  FROM (SELECT entity_id, list(label ORDER BY start_at, end_at, label, k) AS l FROM {table}
        WHERE label <> '{gap}' GROUP BY entity_id)""", table)


@query("order_heuristic", _order_sql("doc_spans", "Unannotated", "Lead", "Position", "Claim", "Concluding Statement"))
def order_heuristic(spark, sf):
    return geometry.order_heuristic(src.doc_spans(spark, sf), DEFAULT_SCHEME)


@query("order_heuristic_events", _order_sql("event_spans", "none", "signup", "view", "click", "purchase"))
def order_heuristic_events(spark, sf):
    return geometry.order_heuristic(src.event_spans(spark, sf), EVENT_SCHEME)


@query("order_vs_ordinal", sql("""SELECT entity_id, list(label ORDER BY start_at, end_at, label, k) = list(label ORDER BY k, label) AS order_matches
  FROM order_line_spans GROUP BY entity_id""", "order_line_spans"))
def order_vs_ordinal(spark, sf):
    return geometry.order_matches_ordinal(src.order_line_spans(spark, sf), "k", FLAG_SCHEME)


@query("missing_labels", sql("""SELECT e.entity_id, coalesce((SELECT string_agg(x, '|' ORDER BY x) FROM
  (VALUES ('Lead'),('Position'),('Claim'),('Counterclaim'),('Rebuttal'),('Evidence'),('Concluding Statement')) v(x)
  WHERE NOT EXISTS (SELECT 1 FROM doc_spans s WHERE s.entity_id = e.entity_id AND s.label = v.x)), '') AS missing_labels
  FROM doc_entities e""", "doc_entities", "doc_spans"))
def missing_labels(spark, sf):
    return geometry.missing_labels(src.doc_spans(spark, sf), src.doc_entities(spark, sf), DEFAULT_SCHEME)


@query("annotation_issues", sql("""SELECT s.entity_id, count(*) AS total_segments,
    count(*) FILTER (label = 'Unannotated') AS unannotated_segments, min(start_at) AS start_min, max(end_at) AS end_max,
    any_value(char_count) AS text_length, count(*) FILTER (label <> 'Unannotated') AS annotated_segments,
    count(*) FILTER (label <> 'Unannotated') = 0 AS has_no_annotations,
    CASE WHEN min(start_at) <> 0 THEN 'does_not_start_at_zero' WHEN max(end_at) <> any_value(char_count) - 1 THEN 'does_not_end_at_last_char'
      WHEN count(*) FILTER (end_at + 1 <> nx) > 0 THEN 'gap_or_overlap' ELSE 'complete_partition' END AS partition_status,
    count(*) FILTER (label <> 'Unannotated' AND end_at >= nxa) AS overlap_pairs
  FROM (SELECT *, lead(start_at) OVER (PARTITION BY entity_id ORDER BY start_at, end_at, label, k) AS nx,
    lead(start_at) OVER (PARTITION BY entity_id, label = 'Unannotated' ORDER BY start_at, end_at, label, k) AS nxa FROM audited) s
  JOIN doc_entities e USING (entity_id) GROUP BY s.entity_id""", "audited", "doc_entities"))
def annotation_issues(spark, sf):
    out = geometry.annotation_issues(src.audited_spans(spark, sf), src.doc_entities(spark, sf))
    return out.select("entity_id", "total_segments", "unannotated_segments", "start_min", "end_max", "text_length",
                      "annotated_segments", "has_no_annotations", "partition_status", "overlap_pairs")


@query("id_set_checks", sql("""SELECT (SELECT count(*) FROM (SELECT entity_id FROM chat_entities WHERE split = 'train'
    INTERSECT SELECT entity_id FROM chat_entities WHERE split = 'test')) AS n_overlap,
  (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_unrated,
  (SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)) AS n_either""", "chat_entities"))
def id_set_checks(spark, sf):
    from spandoc.operators import qa

    chat = src.chat_entities(spark, sf).select("entity_id", "split")
    overlap = qa.id_set_counts(chat.filter("split = 'train'"), chat.filter("split = 'test'"), "entity_id")
    docs = qa.id_set_counts(src.table(spark, sf, "documents"), src.table(spark, sf, "labels"), "doc_id")
    one = overlap.select(F.col("n_both").alias("n_overlap"), F.lit(1).alias("j")).join(
        docs.select(F.col("n_left_only").alias("n_unrated"), F.col("n_either"), F.lit(1).alias("j")), "j")
    return one.drop("j")
