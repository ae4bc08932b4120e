"""DuckDB SQL of the queries that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINES_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents),
keyed AS (
  SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT d.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE r.key IS NOT NULL AND r.keeper <> d.doc_id)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(d.line, chr(10) ORDER BY d.k) FILTER (WHERE r.key IS NULL OR r.keeper = d.doc_id), '')) AS kept_sha256
FROM keyed d LEFT JOIN repeated r ON d.key = r.key GROUP BY d.doc_id"""

_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# Every window is compared as a word list; document windows exist for the lengths that items have.
CONTAMINATION_SQL = rf"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, n, w[k:k + n - 1] AS piece FROM (
    SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM docs JOIN sizes ON len(w) >= n),
hits AS (
  SELECT p.doc_id, p.k, p.n, v.item_id FROM (SELECT doc_id, n, k, w[k:k + n - 1] AS piece FROM places) p
  JOIN windows v ON p.n = v.n AND p.piece = v.piece),
hit_words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM docs d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""

TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([a * q.v[i] FOR a, i IN c.v])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""

SHARDS_SQL = """
WITH rows AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
steps AS (SELECT *, unnest(range(0, 61)) AS depth FROM rows),
sums AS (
  SELECT *, h >> (60 - depth) AS prefix, sum(n_bytes) OVER w AS total, count(*) OVER w AS n
  FROM steps WINDOW w AS (PARTITION BY depth, h >> (60 - depth))),
fit AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS r FROM sums
  WHERE total <= 1048576 OR n = 1 OR depth = 60)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INTEGER, '0') END AS shard, n_bytes,
       total::BIGINT AS shard_bytes, n::BIGINT AS shard_rows, total <= 1048576 AS fits
FROM fit WHERE r = 1"""


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds one after another, with rows (vector, part) against rows (part, entry)."""
    ctes = f"""
v AS MATERIALIZED (
  SELECT vec_id, label, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (
  SELECT vec_id, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS w FROM v, range({parts}) r(part)),
c0 AS MATERIALIZED (
  SELECT part, w AS c, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM p QUALIFY e < {entries})"""
    for k in range(rounds + 1):
        ctes += f""",
a{k} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(e, d * 256 + e) AS e, min(d) AS d, any_value(w) AS w FROM (
    SELECT vec_id, p.part, e, w,
      (list_inner_product(w, w) - 2 * list_inner_product(w, c) + list_inner_product(c, c))::BIGINT AS d
    FROM p JOIN c{k} USING (part)) GROUP BY vec_id, part)"""
        if k < rounds:
            ctes += f""",
m{k} AS (
  SELECT part, e, list(floor(s / n) ORDER BY i) AS c FROM (
    SELECT part, e, i, sum(x) AS s, count(*) AS n FROM (
      SELECT part, e, unnest(w) AS x, unnest(range(len(w))) AS i FROM a{k}) GROUP BY ALL) GROUP BY part, e),
c{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN m{k} m USING (part, e))"""
    return f"""
WITH {ctes},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
books AS (
  SELECT sha256(string_agg(array_to_string([x::BIGINT FOR x IN c], ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN v USING (vec_id), books"""


CODES_SQL = _codes_sql()

# Rows are folded to the set of filters that they fail; every step of every order adds up such sets.
INTERACTIONS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM masks GROUP BY part, mask),
f(name, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT p.name || q.name || r.name || s.name || u.name AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bits
  FROM f p, f q, f r, f s, f u WHERE p.b | q.b | r.b | s.b | u.b = 31),
steps AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS done FROM orders, range(1, 6) t(step)),
counted AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (mask & (done | own) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & done = 0 AND mask & own > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & done > 0 AND mask & own > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(g) FILTER (mask & done = 0 AND mask & own > 0), 0)::BIGINT AS good_lost,
    coalesce(sum(x) FILTER (mask & done = 0 AND mask & own > 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted"""


def _secrets_sql() -> str:
    from spandoc.llm import secret_scan as s

    def quoted(p: str) -> str:
        return "'" + p.replace("'", "''") + "'"

    def found(pattern: str) -> str:
        parts = rf"string_split(regexp_replace(t, {quoted(pattern)}, chr(1) || '\0' || chr(1), 'g'), chr(1))"
        return f"SELECT doc_id, parts, unnest(range(2, len(parts), 2)) AS i FROM (SELECT doc_id, {parts} AS parts FROM texts)"

    def spans(pattern: str, kind: int) -> str:
        return (f"SELECT doc_id, {kind} AS kind, coalesce(list_sum([length(x) FOR x IN parts[1:i - 1]]), 0)::BIGINT AS a, "
                f"length(parts[i]) AS n, parts[i] AS piece FROM ({found(pattern)})")

    allowed = " OR ".join(f"regexp_matches(piece, {quoted(p)})" for p in s.ALLOWED)
    w = s.WINDOW
    return rf"""
WITH texts AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
base AS (
  SELECT doc_id, kind, a, a + n AS z FROM ({spans(s.ASSIGN, 0)}) WHERE length(regexp_extract(piece, {quoted(s.ASSIGN)}, 2)) >= 6
  UNION ALL SELECT doc_id, kind, a, a + n FROM ({spans(s.ACCESS, 1)})
  UNION ALL SELECT doc_id, kind, a, a + n FROM ({spans(s.HEX, 2)})),
runs AS (SELECT *, unnest(range(0, n - {w - 1})) AS off FROM ({spans(s.CANDIDATE, 3)}) WHERE NOT ({allowed})),
high AS (
  SELECT doc_id, a, min(a + off) AS lo, max(a + off + {w}) AS hi FROM runs
  WHERE list_entropy(string_split(substr(piece, off + 1, {w}), ''))
        >= CASE WHEN regexp_matches(piece, {quoted(s.HEX_CLASS)}) THEN {s.HEX_BITS} ELSE {s.OTHER_BITS} END
  GROUP BY doc_id, a),
findings AS (
  SELECT * FROM base
  UNION ALL SELECT doc_id, 3, lo, hi FROM high h
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = h.doc_id AND b.a <= h.lo AND b.z >= h.hi)),
listed AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || a || ':' || z AS name FROM findings)
SELECT t.doc_id, count(*) FILTER (WHERE kind = 0)::BIGINT AS n_assign, count(*) FILTER (WHERE kind = 1)::BIGINT AS n_access,
       count(*) FILTER (WHERE kind = 2)::BIGINT AS n_hex,
       sha256(coalesce(string_agg(name, ',' ORDER BY a, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
       coalesce(string_agg(name, ',' ORDER BY a, kind), '') AS spans
FROM texts t LEFT JOIN listed USING (doc_id) GROUP BY t.doc_id"""


SECRETS_SQL = _secrets_sql()
