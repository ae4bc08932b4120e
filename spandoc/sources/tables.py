"""Reading annotation files and writing / re-reading derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spandoc.schemas import ANNOTATION_SCHEMA, SPAN_ORDER

# Raw column -> span table column.
RAW_TO_SPAN = {
    "essay_id": "entity_id",
    "discourse_type_num": "ordinal",
    "discourse_start": "start_at",
    "discourse_end": "end_at",
    "discourse_type": "label",
    "discourse_text": "span_text",
}


def read_annotations(spark: SparkSession, paths: list[str], schema=ANNOTATION_SCHEMA) -> DataFrame:
    """Read annotation CSVs with a declared schema; ids stay strings.

    A missing path raises.  ``_source_file`` is the file each row came from.
    """
    return (
        spark.read.schema(schema)
        .option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(paths)
        .withColumn("_source_file", F.col("_metadata.file_name"))
    )


def union_sources(sources: dict[str, DataFrame], column: str = "_source_file") -> DataFrame:
    """UNION ALL of named inputs by column name, remembering the name of the input."""
    frames = [df.withColumn(column, F.lit(name)) for name, df in sources.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def spans_of(annotations: DataFrame) -> DataFrame:
    """Raw annotation rows -> span table columns (inclusive 0-based offsets as integers)."""
    cols = [F.col(src).alias(dst) for src, dst in RAW_TO_SPAN.items()]
    return annotations.select(*cols).withColumns(
        {"start_at": F.col("start_at").cast("bigint"), "end_at": F.col("end_at").cast("bigint")}
    )


def restrict(df: DataFrame, ids: DataFrame, column: str = "entity_id") -> DataFrame:
    """Rows whose id occurs in ``ids`` (a semi join, so columns of ``ids`` are not read)."""
    return df.join(ids.select(column), column, "left_semi")


def scan_spans(sources: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """Column-pruned scan of one or more span sources, restricted to an id set."""
    need = ["entity_id", "start_at", "end_at", "label", "k"]
    return restrict(union_sources({n: d.select(*need) for n, d in sources.items()}), ids)


def valid_entities(entities: DataFrame, validation: DataFrame, split: str | None = None) -> DataFrame:
    """Entities that passed validation, optionally of one split."""
    kept = restrict(entities, validation.filter("join_valid"))
    return kept if split is None else kept.filter(F.col("split") == split)


def span_lists(spans: DataFrame) -> DataFrame:
    """One row per entity with its ordered spans as an array.

    For documents: the list is about as large as the text it annotates, which is one
    cell already.  Sequences without that bound stay in the long table, where
    ``spandoc.operators.ordered`` handles them.
    """
    return spans.groupBy("entity_id").agg(
        F.array_sort(F.collect_list(F.struct(*SPAN_ORDER))).alias("spans")
    )


def save(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
         compression: str | None = None) -> None:
    """Persist a derived table (Parquet by default; CSV with a header for exchange, plain unless ``compression`` is given)."""
    writer = df.write.mode("overwrite").format(fmt)
    if compression:
        writer = writer.option("compression", compression)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
        # By default the writer strips texts.
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def load(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Read back a persisted table."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.load(path)
