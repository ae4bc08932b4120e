"""Long-form SQL for every structure feature family (oracle side)."""

from __future__ import annotations

NEIGHBOURS = """nx AS (
  SELECT *, row_number() OVER g AS rk, count(*) OVER (PARTITION BY entity_id, gap) AS n_kind,
    lead(start_at) OVER g AS ns, lead(label) OVER g AS nl, lead(start_at) OVER a AS as_, lead(label) OVER a AS al
  FROM (SELECT entity_id, k, start_at, end_at, label, label = '{gap}' AS gap FROM {spans})
  WINDOW g AS (PARTITION BY entity_id, gap ORDER BY start_at, end_at, label, k),
         a AS (PARTITION BY entity_id ORDER BY start_at, end_at, label, k)),
ln AS (SELECT entity_id, CAST(greatest(char_count, 1) AS DOUBLE) AS n FROM {ents})"""

KEY = "replace({}, ' ', '_')"

FAMILY_SQL = {
    "count": f"""
  SELECT entity_id, 'count_total_components' AS feature, CAST(count(*) FILTER (NOT gap) AS DOUBLE) AS value FROM nx GROUP BY entity_id
  UNION ALL SELECT entity_id, 'count_total_segments', count(*) FROM nx GROUP BY entity_id
  UNION ALL SELECT entity_id, 'count_annotation_coverage', sum(end_at - start_at + 1) / any_value(n) FROM nx JOIN ln USING (entity_id) GROUP BY entity_id
  UNION ALL SELECT entity_id, 'count_unannotated_gaps', count(*) FILTER (gap) FROM nx GROUP BY entity_id
  UNION ALL SELECT entity_id, 'count_unannotated_proportion', count(*) FILTER (gap) / CAST(count(*) AS DOUBLE) FROM nx GROUP BY entity_id
  UNION ALL SELECT entity_id, 'count_' || {KEY.format('label')}, count(*) FROM nx WHERE NOT gap AND label IN (LABELS) GROUP BY entity_id, label
  UNION ALL SELECT entity_id, 'prop_' || {KEY.format('label')}, count(*) / CAST(any_value(n_kind) AS DOUBLE) FROM nx WHERE NOT gap AND label IN (LABELS) GROUP BY entity_id, label""",
    "firstlast": f"""
  SELECT entity_id, 'order_first_is_' || {KEY.format('label')} AS feature, CAST(1 AS DOUBLE) AS value FROM nx WHERE NOT gap AND rk = 1 AND label IN (LABELS)
  UNION ALL SELECT entity_id, 'order_final_is_' || {KEY.format('label')}, 1 FROM nx WHERE NOT gap AND rk = n_kind AND label IN (LABELS)""",
    "transition": f"""
  SELECT entity_id, 'order_trans_' || {KEY.format('label')} || '__' || {KEY.format('nl')} AS feature,
         count(*) / CAST(any_value(n_kind) - 1 AS DOUBLE) AS value
  FROM nx WHERE NOT gap AND rk < n_kind AND label IN (LABELS) AND nl IN (LABELS) GROUP BY entity_id, label, nl""",
    "label_position": f"""
  SELECT entity_id, 'order_' || p || '_pos_' || {KEY.format('label')} AS feature,
    CASE p WHEN 'mean' THEN m WHEN 'first' THEN f WHEN 'final' THEN l ELSE s END / n AS value
  FROM (SELECT entity_id, label, avg((start_at + end_at) / 2.0e0) AS m, arg_min((start_at + end_at) / 2.0e0, rk) AS f,
          arg_max((start_at + end_at) / 2.0e0, rk) AS l, stddev_pop((start_at + end_at) / 2.0e0) AS s
        FROM nx WHERE NOT gap AND label IN (LABELS) GROUP BY entity_id, label) JOIN ln USING (entity_id),
       (VALUES ('mean'), ('first'), ('final'), ('std')) v(p)""",
    "boundary": """
  SELECT entity_id, 'pos_start_rank_' || (rk - 1) AS feature, start_at / n AS value FROM nx JOIN ln USING (entity_id) WHERE NOT gap AND rk <= RANKS
  UNION ALL SELECT entity_id, 'pos_end_rank_' || (rk - 1), (end_at + 1) / n FROM nx JOIN ln USING (entity_id) WHERE NOT gap AND rk <= RANKS
  UNION ALL SELECT entity_id, 'pos_len_' || p, CASE p WHEN 'mean' THEN avg(w) WHEN 'std' THEN stddev_pop(w) WHEN 'min' THEN min(w) ELSE max(w) END
    FROM (SELECT entity_id, (end_at - start_at + 1) / n AS w FROM nx JOIN ln USING (entity_id) WHERE NOT gap),
         (VALUES ('mean'), ('std'), ('min'), ('max')) v(p) GROUP BY entity_id, p
  UNION ALL SELECT entity_id, 'pos_gap_' || p, CASE p WHEN 'count' THEN count(*) WHEN 'len_mean' THEN avg(g) WHEN 'len_std' THEN stddev_pop(g)
      WHEN 'len_max' THEN max(g) ELSE avg(pt) END
    FROM (SELECT entity_id, (as_ - end_at - 1) / n AS g, (end_at + 1) / n AS pt FROM nx JOIN ln USING (entity_id)
            WHERE (gap OR al = 'GAP') AND as_ - end_at - 1 > 0
          UNION ALL SELECT entity_id, (ns - end_at - 1) / n, (end_at + 1) / n FROM nx JOIN ln USING (entity_id) WHERE NOT gap AND ns - end_at - 1 > 0),
         (VALUES ('count'), ('len_mean'), ('len_std'), ('len_max'), ('pos_mean')) v(p) GROUP BY entity_id, p""",
    "comp_count": """
  SELECT entity_id, 'pos_comp_count' AS feature, CAST(count(*) FILTER (NOT gap) AS DOUBLE) AS value FROM nx GROUP BY entity_id""",
    "boundary_coverage": """
  SELECT entity_id, 'boundary_coverage' AS feature, sum(end_at - start_at + 1) / any_value(n) AS value FROM nx JOIN ln USING (entity_id) GROUP BY entity_id""",
    "surface": r"""
  SELECT entity_id, 'surface_' || p AS feature, CAST(CASE p WHEN 'word_count' THEN len(w) WHEN 'char_count' THEN length(text)
      WHEN 'sentence_count' THEN greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_matches(x, '\S'))))
      WHEN 'paragraph_count' THEN greatest(1, len(list_filter(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\n\s*\n'), lambda x: regexp_matches(x, '\S'))))
      ELSE CASE WHEN len(w) = 0 THEN 0 ELSE list_sum(list_transform(w, lambda x: length(x))) / CAST(len(w) AS DOUBLE) END END AS DOUBLE) AS value
  FROM (SELECT entity_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM doc_entities),
    (VALUES ('word_count'), ('char_count'), ('sentence_count'), ('paragraph_count'), ('mean_word_length')) v(p)""",
}
FAMILY_SQL["geometry"] = FAMILY_SQL["boundary"] + "\n  UNION ALL " + FAMILY_SQL["comp_count"].strip()
FAMILY_SQL["boundary_only"] = FAMILY_SQL["boundary"] + "\n  UNION ALL " + FAMILY_SQL["boundary_coverage"].strip()


def features_extra(spans: str, ents: str, labels, gap: str) -> str:
    return NEIGHBOURS.format(spans=spans, ents=ents, gap=gap)


def features_select(families, labels, gap: str, ranks: str = "0") -> str:
    quoted = ", ".join(f"'{x}'" for x in labels)
    parts = [FAMILY_SQL[f].replace("LABELS", quoted).replace("RANKS", ranks).replace("GAP", gap).strip() for f in families]
    return "\nUNION ALL\n".join(parts)


def features_body(families, labels, gap: str, ranks: str = "0", digits: int = 6) -> str:
    inner = features_select(families, labels, gap, ranks)
    return f"SELECT entity_id, feature, round(value, {digits}) AS value FROM ({inner}) WHERE round(value, {digits}) <> 0"
