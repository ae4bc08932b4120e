"""The registered queries: thin steps from the given tables to the operators and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from spandoc.llm.bpe import decode, encode, ids_text, read_ranks
from spandoc.llm.codes import compress_vectors
from spandoc.llm.common import hex_digits
from spandoc.llm.decontam import contamination
from spandoc.llm.interactions import TEXT_FILTERS, filter_interactions, text_failures
from spandoc.llm.lines import drop_repeated_lines
from spandoc.llm.secret_scan import secret_spans
from spandoc.llm.sharding import extendible_shards
from spandoc.llm.simhash import near_copies
from spandoc.llm.main_text import extract
from spandoc.llm.ngram import score_texts
from spandoc.llm.pieces import read_model, round_trip
from spandoc.llm.quality import fit_quality, score_quality
from spandoc.llm.registry import ORACLES, QUERIES, entities, query
from spandoc.llm.sql import CODES_SQL, CONTAMINATION_SQL, INTERACTIONS_SQL, LINES_SQL, SECRETS_SQL, SHARDS_SQL, TOP_K_SQL
from spandoc.llm.topk import exact_top_k

__all__ = ["ORACLES", "QUERIES"]


@query("op1_line_dedup", LINES_SQL)
def op1(spark, sf_dir):
    out = drop_repeated_lines(entities(spark, sf_dir))
    return out.select(
        F.col("entity_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op4_simhash_near_dedup")
def op4(spark, sf_dir):
    out = near_copies(entities(spark, sf_dir))
    return out.select(F.col("entity_id").alias("doc_id"), hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op8_benchmark_decontamination", CONTAMINATION_SQL)
def op8(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = contamination(entities(spark, sf_dir), items, with_text=False)
    return out.withColumnRenamed("entity_id", "doc_id")


def tokenizer() -> dict[bytes, int]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("op9_byte_bpe")
def op9(spark, sf_dir):
    import public_tokenizers

    ranks = tokenizer()
    out = decode(encode(entities(spark, sf_dir), ranks, public_tokenizers.PATTERN), ranks)
    return out.select(
        F.col("entity_id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids_text(F.col("ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(entity_id, fold: int, of: int = 5):
    """Rows whose crc32 of the id as text leaves ``fold`` modulo ``of``."""
    return F.crc32(entity_id.cast("string").cast("binary")) % of == fold


def learn_quality(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("entity_id"), "quality")
    return fit_quality(docs, labels.filter(~held_out(F.col("entity_id"), 0)))


@query("op7_quality_classifier")
def op7(spark, sf_dir):
    docs = entities(spark, sf_dir)
    out = score_quality(docs, learn_quality(spark, docs, sf_dir))
    return out.select(
        F.col("entity_id").alias("doc_id"), F.coalesce(held_out(F.col("entity_id"), 0), F.lit(False)).alias("held_out"),
        F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"))


@query("op2_exact_top_k", TOP_K_SQL)
def op2(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("entity_id"), "embedding")
    out = exact_top_k(vectors, vectors.filter(F.col("entity_id") % 100 == 0))
    return out.select("query_id", "rank", F.col("entity_id").alias("vec_id"), "score")


@query("op3_extendible_shards", SHARDS_SQL)
def op3(spark, sf_dir):
    return extendible_shards(entities(spark, sf_dir)).withColumnRenamed("entity_id", "doc_id")


@query("op5_secret_scan", SECRETS_SQL)
def op5(spark, sf_dir):
    found = secret_spans(entities(spark, sf_dir))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["label"], s["start_at"], s["end_at"] + 1)), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["label"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        F.col("entity_id").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["label"] != "entropy")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))


@query("op6_main_text")
def op6(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("entity_id"), "url", "html")
    return extract(pages).select(
        F.col("entity_id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op10_lm_scores")
def op10(spark, sf_dir):
    docs = entities(spark, sf_dir)
    out = score_texts(docs, ~held_out(F.col("entity_id"), 1), held_out(F.col("entity_id"), 2, 20))
    return out.select(
        F.col("entity_id").alias("doc_id"), F.coalesce(held_out(F.col("entity_id"), 1), F.lit(False)).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_sentencepiece")
def op11(spark, sf_dir):
    import public_tokenizers

    out = round_trip(entities(spark, sf_dir), read_model(public_tokenizers.path("piece_bpe_32k.model")))
    return out.select(
        F.col("entity_id").alias("doc_id"), (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


@query("op12_vector_codes", CODES_SQL)
def op12(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("entity_id"), "embedding", F.col("label").alias("grp"))
    found = compress_vectors(vectors)
    return found.codes.select(
        F.col("entity_id").alias("vec_id"), "code", "error", F.col("grp_error").alias("label_error"),
        F.sha2(F.lit(found.codebooks_text()), 256).alias("codebooks_sha256"))


@query("op13_filter_audit", INTERACTIONS_SQL)
def op13(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select(F.col("doc_id").alias("entity_id"), "text", F.col("source").alias("grp"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy(F.col("doc_id").alias("entity_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = text_failures(docs).join(labels, "entity_id", "left")
    out = filter_interactions(rows, {f: F.col(f) for f in TEXT_FILTERS}, {"good": F.col("good"), "toxic": F.col("toxic")})
    return out.withColumnRenamed("grp", "part")
