"""Test tables seen as (entities, spans).  Every adapter is lazy and reads only its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spandoc.functions.keyed import keyed_int
from spandoc.functions.text import char_count, running_offsets
from spandoc.operators.ordered import cut_hot, neighbours
from spandoc.schemas import DEFAULT_SCHEME

# Amplitude of the keyed noise per base condition of the prediction fixture.
FIXED_CONDITIONS = {
    "T2": 2.5, "POS": 1.9, "T3": 1.8, "POS_TRANS": 1.7, "T3_PLUS_POS": 1.5,
    "N1": 2.45, "N2": 2.1, "REAL_BOUNDARY_SHUFFLED_LABEL": 2.0,
}
CONTROL_CONDITIONS = {"TS": 2.2, "RB": 2.3, "RND": 2.6, "NS": 2.35}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _split_column(entity_id: Column) -> Column:
    return F.when(keyed_int("split", entity_id) % 10 < 6, "train").otherwise("test")


def chat_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation; the text is the turns joined by one newline."""
    turns = table(spark, sf_dir, "conversations")
    eid = F.col("entity_id")
    return (
        turns.groupBy("conv_id")
        .agg((F.sum(F.length("text") + 1) - 1).cast("bigint").alias("char_count"))
        .select(
            F.col("conv_id").cast("string").alias("entity_id"), "char_count",
            F.concat(F.lit("g"), (F.col("conv_id") % 5).cast("string")).alias("grp"),
            F.concat(F.lit("s"), (F.col("conv_id") % 2).cast("string")).alias("subgrp"),
        )
        .withColumns({"score": keyed_int("score", eid) % 6 + 1, "split": _split_column(eid)})
    )


def chat_spans(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """One row per turn, offsets inside the joined text; role ``system`` is the gap label."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("entity_id"), F.col("turn").alias("k"),
        F.col("role").alias("label"), F.length("text").cast("bigint").alias("n"),
        *([F.col("text").alias("span_text")] if with_text else []),
    ).withColumn("step", F.col("n") + 1)
    cut = cut_hot(turns, "entity_id", ["k"])
    placed = neighbours(cut, ["k"], running={"start_at": "step"}).finish()
    return placed.select(
        "entity_id", "k", "start_at", (F.col("start_at") + F.col("n") - 1).alias("end_at"), "label",
        *(["span_text"] if with_text else []),
    )


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: from whole seconds since the user's first event to the next start."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("entity_id"), F.col("event_id").alias("k"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("label"),
    )
    first = ev.groupBy("entity_id").agg(F.min("us").alias("us0"))
    timed = ev.join(first, "entity_id").withColumn(
        "start_at", F.floor((F.col("us") - F.col("us0")) / F.lit(1000000)).cast("bigint")
    )
    cut = cut_hot(timed, "entity_id", ["us", "k"])
    nxt = neighbours(cut, ["us", "k"], lead={"next_start": "start_at"}).finish()
    end = F.greatest(F.col("start_at"), F.coalesce(F.col("next_start") - 1, F.col("start_at")))
    return nxt.select("entity_id", "k", "start_at", end.alias("end_at"), "label")


def order_line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: days since the order's first shipment, as long as the quantity."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("entity_id"), F.col("l_linenumber").cast("bigint").alias("k"),
        F.to_date("l_shipdate").alias("d"), F.col("l_quantity").cast("bigint").alias("q"),
        F.col("l_returnflag").alias("label"),
    )
    first = li.groupBy("entity_id").agg(F.min("d").alias("d0"))
    start = F.datediff("d", "d0").cast("bigint")
    return li.join(first, "entity_id").select(
        "entity_id", "k", start.alias("start_at"), (start + F.col("q")).alias("end_at"), "label"
    )


def order_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with score = first digit of the priority, grouped by market segment."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("entity_id"), "o_custkey",
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("score"),
        F.col("o_orderstatus").alias("subgrp"),
    )
    cust = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("grp"))
    return orders.join(cust, orders.o_custkey == cust.c_custkey, "left").select(
        "entity_id", "score", "grp", "subgrp"
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed predictions of every condition for the orders, in the long prediction layout."""
    from spandoc.schemas import CONTROL_SEEDS

    rows = [(c, c, None, a) for c, a in FIXED_CONDITIONS.items()]
    rows += [(f"{c}_s{s}", c, s, a) for c, a in CONTROL_CONDITIONS.items() for s in CONTROL_SEEDS]
    spec = F.array(*[
        F.struct(F.lit(n).alias("condition"), F.lit(b).alias("base"),
                 F.lit(s).cast("bigint").alias("seed"), F.lit(a).alias("amp"))
        for n, b, s, a in rows
    ])
    noise = keyed_int(F.col("c.condition"), F.col("entity_id")) / F.lit(4294967296.0) - F.lit(0.5)
    return (
        order_entities(spark, sf_dir)
        .withColumn("c", F.explode(spec))
        .select(
            "c.condition", "c.base", "c.seed", "entity_id", "grp", "subgrp",
            F.col("score").alias("y_true"),
            (F.col("score") + noise * F.col("c.amp")).alias("y_pred"),
        )
    )


def doc_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    eid = F.col("doc_id").cast("string")
    return docs.select(
        eid.alias("entity_id"), "text", char_count(F.col("text")).alias("char_count"),
        (F.least(F.lit(5), F.floor(F.col("n_chars") / 800)) + 1).cast("bigint").alias("score"),
        F.col("source").alias("grp"), F.col("lang").alias("subgrp"), _split_column(eid).alias("split"),
    )


def _doc_label(eid: Column, k: Column) -> Column:
    names = F.array(*[F.lit(x) for x in (*DEFAULT_SCHEME.labels, DEFAULT_SCHEME.gap)])
    return F.get(names, (keyed_int("label", eid, k) % 8).cast("int"))


def doc_lines(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """Non-empty lines of each document.  Offsets are found inside the row, without a shuffle."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("entity_id"), "text")
    lines = F.split("text", "\n")
    parts = docs.select("entity_id", F.length("text").cast("bigint").alias("doc_len"), lines.alias("lines"))
    # Lengths get a column of their own: the offsets read them once per block.
    sized = parts.withColumn("lens", F.transform("lines", lambda x: F.length(x) + 1)).withColumn(
        "offsets", running_offsets(F.col("lens")))
    pos = F.arrays_zip("lines", "offsets")
    rows = sized.select("entity_id", "doc_len", F.posexplode(pos).alias("k", "p")).filter(
        F.length("p.lines") > 0
    )
    k = F.col("k").cast("bigint")
    start = F.col("p.offsets")
    return rows.select(
        "entity_id", k.alias("k"), start.alias("start_at"),
        (start + F.length("p.lines") - 1).cast("bigint").alias("end_at"),
        _doc_label(F.col("entity_id"), k).alias("label"), "doc_len",
        *([F.col("p.lines").alias("span_text")] if with_text else []),
    )


def doc_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).drop("doc_len")


def audited_spans(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """Document lines with keyed annotation faults, so that every audit outcome occurs.

    Every third document swallows its line breaks (complete partitions), every fifth
    document stretches a line over its neighbour; borders and quoted texts vary by key.
    """
    lines = doc_lines(spark, sf_dir, with_text)
    key = keyed_int("fault", F.col("entity_id"), F.col("k")) % 24
    doc = F.col("entity_id").cast("bigint")
    swallow = F.when((doc % 3 == 0) & (F.col("end_at") < F.col("doc_len") - 1), 1).otherwise(0)
    stretch = F.when((doc % 5 == 1) & (key < 4), 9).otherwise(0)
    out = lines.withColumns({"f": key, "e0": F.col("end_at")})
    end = F.when(doc % 7 != 2, F.col("end_at") + swallow + stretch).when(
        key == 0, F.lit(-2)).when(key == 1, F.col("doc_len") + 3).otherwise(F.col("end_at"))
    out = out.withColumn("end_at", end.cast("bigint"))
    if with_text:
        t = F.col("span_text")
        quoted = (
            F.when(F.col("f") < 8, t)
            .when(F.col("f") < 10, F.substring(t, F.lit(1), F.length(t) - 1))
            .when(F.col("f") < 12, F.concat(F.lit(" \t"), t, F.lit("\n")))
            .when(F.col("f") < 14, F.concat(F.substring(t, F.lit(1), F.length(t) - 1), F.lit(" ")))
            .when(F.col("f") < 18, F.substring(t, F.lit(2), F.length(t) - 2))
            .when(F.col("f") < 20, F.reverse(t))
            .when(F.col("f") < 21, F.lit(None).cast("string"))
            .otherwise(t)
        )
        out = out.withColumn("span_text", quoted)
    cols = ["entity_id", "k", "start_at", "end_at", "label", *(["span_text"] if with_text else [])]
    return out.select(*cols)


def annotation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw annotation layout: one row per span, document fields repeated, some in conflict.

    Spans and documents merge by entity at any size.  With either side broadcast the rows would come in no order, and
    whoever groups them by entity would sort every row with its text.
    """
    spans = audited_spans(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("entity_id"), "text", F.col("source").alias("grp"),
        F.col("lang").alias("subgrp"), "n_chars",
    )
    quality = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("entity_id"), "quality", F.lit(True).alias("rated")
    )
    eid, k = F.col("entity_id"), F.col("k")
    rows = spans.join(docs.hint("merge"), "entity_id").join(quality, "entity_id", "left")
    odd = keyed_int("odd", eid, k)
    home = _split_column(eid)
    return rows.select(
        "entity_id", k.alias("row_no"),
        F.when(odd % 97 == 0, F.concat("text", F.lit(" "))).when(odd % 89 == 0, None)
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("rated"), (F.least(F.lit(5), F.floor(F.col("n_chars") / 800)) + 1
                                + F.when(odd % 83 == 0, 1).otherwise(0)).cast("double")).alias("score"),
        F.when(keyed_int("grp", eid) % 50 == 0, F.lit(" ")).otherwise(F.col("grp")).alias("grp"), "subgrp",
        F.when(odd % 101 == 0, "test").otherwise(home).alias("split"),
        F.when(odd % 3 == 0, None).otherwise((odd % 5 + 8).cast("double")).alias("grade"),
        F.when(odd % 2 == 0, F.col("n_chars")).alias("word_count_field"),
        "start_at", "end_at", "label",
        F.when((F.col("label") != DEFAULT_SCHEME.gap) & (F.col("quality") == 1) & (odd % 7 == 0), "Effective")
        .alias("effectiveness"),
        F.when(home == "train", "train.csv").otherwise("test.csv").alias("source_file"),
    )


def vector_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    eid = F.col("vec_id").cast("string")
    return emb.select(
        eid.alias("entity_id"), "embedding", F.col("label").cast("bigint").alias("score"),
        _split_column(eid).alias("split"),
    )
