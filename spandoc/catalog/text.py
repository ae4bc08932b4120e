"""Text queries: term counts, vocabulary, weights, token truncation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spandoc.catalog.ctes import sql
from spandoc.catalog.registry import query
from spandoc.functions import text as tx
from spandoc.operators import sequences, tfidf
from spandoc.sources import adapters as src


@query("text_counts", sql(r"""SELECT entity_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS n_words, CAST(length(text) AS BIGINT) AS n_chars,
  greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_matches(x, '\S')))) AS n_sentences,
  greatest(1, len(list_filter(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\n\s*\n'), lambda x: regexp_matches(x, '\S')))) AS n_paragraphs
  FROM doc_entities""", "doc_entities"))
def text_counts(spark, sf):
    t = F.col("text")
    return src.doc_entities(spark, sf).select(
        "entity_id", tx.word_count(t).alias("n_words"), tx.char_count(t).alias("n_chars"),
        tx.sentence_count(t).alias("n_sentences"), tx.paragraph_count(t).alias("n_paragraphs"))


_TERMS = r"""tok AS (SELECT entity_id, split, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda x: true) AS w FROM doc_entities),
uni AS (SELECT entity_id, split, unnest(w) AS term, unnest(range(len(w))) AS i FROM tok),
terms AS (SELECT entity_id, split, term FROM uni
  UNION ALL SELECT a.entity_id, a.split, a.term || ' ' || b.term FROM uni a JOIN uni b ON a.entity_id = b.entity_id AND b.i = a.i + 1),
tc AS (SELECT entity_id, split, term, count(*) AS tf FROM terms GROUP BY ALL),
vocab AS (SELECT *, row_number() OVER (ORDER BY term) - 1 AS term_id FROM
  (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM tc WHERE split = 'train' GROUP BY term HAVING count(*) >= 3
   ORDER BY total_tf DESC, term LIMIT 30000))"""


@query("tfidf_terms", sql("SELECT entity_id, term, tf FROM tc", "doc_entities", extra=_TERMS))
def tfidf_terms(spark, sf):
    return tfidf.term_counts(src.doc_entities(spark, sf))


@query("tfidf_vocabulary", sql("SELECT term, df, total_tf, term_id FROM vocab", "doc_entities", extra=_TERMS))
def tfidf_vocabulary(spark, sf):
    return tfidf.fit_vocabulary(tfidf.term_counts(src.doc_entities(spark, sf).filter("split = 'train'")))


@query("tfidf_weights", sql("""SELECT entity_id, term_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY entity_id)), 6) AS weight
  FROM (SELECT entity_id, term_id, term, tf * (ln((1.0e0 + (SELECT count(*) FROM doc_entities WHERE split = 'train')) / (1.0e0 + df)) + 1) AS x
        FROM tc JOIN vocab USING (term))""", "doc_entities", extra=_TERMS))
def tfidf_weights(spark, sf):
    ents = src.doc_entities(spark, sf)
    train = ents.filter("split = 'train'")
    model = tfidf.fit_tfidf(tfidf.term_counts(train), train.count())
    return model.transform(tfidf.term_counts(ents)).withColumn("weight", F.round("weight", 6))


def _head_tail_sql(m: int, h: int, t: int, joined: str) -> str:
    return sql(rf"""SELECT entity_id, CAST(len(o) AS BIGINT) AS n_tokens, array_to_string(o, ' ') AS tokens, CAST({m} AS BIGINT) AS padded_size,
      CAST(len(o) AS BIGINT) AS mask_sum FROM (SELECT entity_id, CASE WHEN len(w) <= {m} THEN w ELSE {joined} END AS o
      FROM (SELECT entity_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS w FROM doc_entities))""", "doc_entities")


def _head_tail(m: int, h: int, t: int):
    def run(spark, sf):
        cut = src.doc_entities(spark, sf).select("entity_id", tx.words(F.col("text")).alias("w")).select(
            "entity_id", sequences.head_tail(F.col("w"), m, h, t).alias("o"))
        pad = sequences.padded(F.col("o"), m, F.lit(""))
        mask = sequences.attention_mask(F.col("o"), m)
        return cut.select(
            "entity_id", F.size("o").cast("bigint").alias("n_tokens"), F.array_join("o", " ").alias("tokens"),
            F.size(pad).cast("bigint").alias("padded_size"),
            F.aggregate(mask, F.lit(0).cast("bigint"), lambda a, x: (a + x).cast("bigint")).alias("mask_sum"))

    return run


query("head_tail_tokens", _head_tail_sql(512, 256, 256, "list_concat(w[1:256], w[-256:])"))(_head_tail(512, 256, 256))
query("head_tail_overfull", _head_tail_sql(
    40, 30, 20, "list_concat(list_concat(w[1:30], w[-20:])[1:35], list_concat(w[1:30], w[-20:])[-5:])"))(_head_tail(40, 30, 20))
