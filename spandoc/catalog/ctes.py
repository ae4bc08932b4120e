"""DuckDB renderings of the adapters, written with windows and joins (not a port of the plans)."""

LABELS = "['Lead','Position','Claim','Counterclaim','Rebuttal','Evidence','Concluding Statement','Unannotated']"


def h(*parts: str, digits: int = 8) -> str:
    """Keyed integer of SQL expressions / quoted literals."""
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({joined}), 1, {digits})) AS BIGINT)"


CTE = {
    "chat_spans": """chat_spans AS (
  SELECT CAST(conv_id AS VARCHAR) AS entity_id, turn AS k, role AS label, text AS span_text,
         CAST(coalesce(sum(length(text) + 1) OVER w, 0) AS BIGINT) AS start_at,
         CAST(coalesce(sum(length(text) + 1) OVER w, 0) + length(text) - 1 AS BIGINT) AS end_at
  FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    "chat_entities": f"""chat_entities AS (
  SELECT entity_id, CAST(sum(n) - 1 AS BIGINT) AS char_count, 'g' || (CAST(entity_id AS BIGINT) % 5) AS grp,
         's' || (CAST(entity_id AS BIGINT) % 2) AS subgrp,
         {h("'score'", "entity_id")} % 6 + 1 AS score,
         CASE WHEN {h("'split'", "entity_id")} % 10 < 6 THEN 'train' ELSE 'test' END AS split
  FROM (SELECT CAST(conv_id AS VARCHAR) AS entity_id, length(text) + 1 AS n FROM conversations) GROUP BY entity_id)""",
    "event_spans": """event_spans AS (
  SELECT entity_id, k, label, start_at,
         greatest(start_at, coalesce(lead(start_at) OVER (PARTITION BY entity_id ORDER BY us, k) - 1, start_at)) AS end_at
  FROM (SELECT CAST(user_id AS VARCHAR) AS entity_id, event_id AS k, event_type AS label, epoch_us(ts) AS us,
               (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000000 AS start_at
        FROM events))""",
    "order_line_spans": """order_line_spans AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS entity_id, CAST(l_linenumber AS BIGINT) AS k, l_returnflag AS label,
         date_diff('day', min(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_orderkey), CAST(l_shipdate AS DATE)) AS start_at,
         date_diff('day', min(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_orderkey), CAST(l_shipdate AS DATE))
           + CAST(l_quantity AS BIGINT) AS end_at
  FROM lineitem)""",
    "order_entities": """order_entities AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS score,
         c_mktsegment AS grp, o_orderstatus AS subgrp
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)""",
    "conds": """conds(condition, base, seed, amp) AS (
  SELECT base, base, CAST(NULL AS BIGINT), amp FROM (VALUES ('T2', 2.5e0), ('POS', 1.9e0), ('T3', 1.8e0),
    ('POS_TRANS', 1.7e0), ('T3_PLUS_POS', 1.5e0), ('N1', 2.45e0), ('N2', 2.1e0), ('REAL_BOUNDARY_SHUFFLED_LABEL', 2.0e0)) f(base, amp)
  UNION ALL
  SELECT base || '_s' || seed, base, CAST(seed AS BIGINT), amp
  FROM (VALUES ('TS', 2.2e0), ('RB', 2.3e0), ('RND', 2.6e0), ('NS', 2.35e0)) c(base, amp), (VALUES (13), (21), (42), (87), (101)) s(seed))""",
    "preds": f"""preds AS (
  SELECT condition, base, seed, entity_id, grp, subgrp, score AS y_true,
         score + ({h("condition", "entity_id")} / 4294967296.0e0 - 0.5e0) * amp AS y_pred
  FROM order_entities, conds)""",
    "rounded": """rounded AS (
  SELECT *, least(greatest(y_pred, 1e0), 6e0) AS y_clip,
         CAST(round_even(least(greatest(y_pred, 1e0), 6e0), 0) AS BIGINT) AS y_round FROM preds)""",
    "doc_entities": f"""doc_entities AS (
  SELECT CAST(doc_id AS VARCHAR) AS entity_id, text, CAST(length(text) AS BIGINT) AS char_count,
         CAST(1 + least(5, n_chars // 800) AS BIGINT) AS score, source AS grp, lang AS subgrp,
         CASE WHEN {h("'split'", "doc_id")} % 10 < 6 THEN 'train' ELSE 'test' END AS split
  FROM documents)""",
    "doc_lines": f"""doc_lines AS (
  SELECT entity_id, k, s AS start_at, s + length(line) - 1 AS end_at, line AS span_text, doc_len,
         list_extract({LABELS}, CAST({h("'label'", "entity_id", "k")} % 8 + 1 AS INT)) AS label
  FROM (SELECT entity_id, k, line, doc_len,
               CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY entity_id ORDER BY k
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
        FROM (SELECT CAST(doc_id AS VARCHAR) AS entity_id, CAST(length(text) AS BIGINT) AS doc_len,
                     unnest(string_split(text, chr(10))) AS line,
                     unnest(range(len(string_split(text, chr(10))))) AS k FROM documents))
  WHERE length(line) > 0)""",
    "doc_spans": "doc_spans AS (SELECT entity_id, k, start_at, end_at, label FROM doc_lines)",
    "audited": f"""audited AS (
  SELECT entity_id, k, start_at, label, f,
         CAST(CASE WHEN d % 7 <> 2 THEN end_at + (CASE WHEN d % 3 = 0 AND end_at < doc_len - 1 THEN 1 ELSE 0 END)
                        + (CASE WHEN d % 5 = 1 AND f < 4 THEN 9 ELSE 0 END)
                   WHEN f = 0 THEN -2 WHEN f = 1 THEN doc_len + 3 ELSE end_at END AS BIGINT) AS end_at,
         CASE WHEN f < 8 THEN span_text
              WHEN f < 10 THEN substr(span_text, 1, length(span_text) - 1)
              WHEN f < 12 THEN ' ' || chr(9) || span_text || chr(10)
              WHEN f < 14 THEN substr(span_text, 1, length(span_text) - 1) || ' '
              WHEN f < 18 THEN substr(span_text, 2, greatest(length(span_text) - 2, 0))
              WHEN f < 20 THEN reverse(span_text) WHEN f < 21 THEN NULL ELSE span_text END AS span_text
  FROM (SELECT *, CAST(entity_id AS BIGINT) AS d, {h("'fault'", "entity_id", "k")} % 24 AS f FROM doc_lines))""",
    "annot": f"""annot AS (
  SELECT entity_id, k AS row_no,
         CASE WHEN odd % 97 = 0 THEN text || ' ' WHEN odd % 89 = 0 THEN NULL ELSE text END AS text,
         CASE WHEN rated THEN CAST(1 + least(5, n_chars // 800) + (CASE WHEN odd % 83 = 0 THEN 1 ELSE 0 END) AS DOUBLE) END AS score,
         CASE WHEN {h("'grp'", "entity_id")} % 50 = 0 THEN ' ' ELSE source END AS grp, lang AS subgrp,
         CASE WHEN odd % 101 = 0 THEN 'test' ELSE home END AS split,
         CASE WHEN odd % 3 <> 0 THEN CAST(odd % 5 + 8 AS DOUBLE) END AS grade,
         CASE WHEN odd % 2 = 0 THEN n_chars END AS word_count_field, start_at, end_at, label,
         CASE WHEN label <> 'Unannotated' AND quality = 1 AND odd % 7 = 0 THEN 'Effective' END AS effectiveness,
         CASE WHEN home = 'train' THEN 'train.csv' ELSE 'test.csv' END AS source_file
  FROM (SELECT a.*, d.text, d.source, d.lang, d.n_chars, l.quality, l.doc_id IS NOT NULL AS rated,
               {h("'odd'", "a.entity_id", "a.k")} AS odd,
               CASE WHEN {h("'split'", "a.entity_id")} % 10 < 6 THEN 'train' ELSE 'test' END AS home
        FROM audited a JOIN documents d ON a.entity_id = CAST(d.doc_id AS VARCHAR)
        LEFT JOIN labels l ON l.doc_id = d.doc_id))""",
}

NEEDS = {
    "rounded": ["order_entities", "conds", "preds"],
    "preds": ["order_entities", "conds"],
    "doc_spans": ["doc_lines"],
    "audited": ["doc_lines"],
    "annot": ["doc_lines", "audited"],
}


def sql(body: str, *names: str, extra: str = "", recursive: bool = False) -> str:
    """``WITH`` the named adapter CTEs (and what they need) followed by ``extra`` CTEs and the body."""
    seen: list[str] = []
    for n in names:
        for m in (*NEEDS.get(n, []), n):
            if m not in seen:
                seen.append(m)
    parts = [CTE[n] for n in seen]
    if extra:
        parts.append(extra.strip().rstrip(","))
    return ("WITH " + "RECURSIVE " * recursive + ",\n".join(parts) + "\n" if parts else "") + body.strip()
