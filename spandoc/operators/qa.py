"""Feature manifests, leakage and protocol checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spandoc.schemas import FORBIDDEN_PREFIXES


def family_of(name: Column, families: dict[str, str]) -> Column:
    """Family of a feature, looked up by its name (``plans.conditions.feature_families`` has them)."""
    if not families:
        return F.lit("other")
    known = F.create_map(*[F.lit(x) for pair in families.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), F.lit("other"))


def has_forbidden_prefix(name: Column, prefixes=FORBIDDEN_PREFIXES) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(F.lower(name), p))


def manifest(features: DataFrame, families: dict[str, str]) -> DataFrame:
    """(condition, feature_name) -> with family and leakage flag."""
    name = F.col("feature_name")
    return features.withColumns(
        {"feature_family": family_of(name, families), "contains_forbidden_token": has_forbidden_prefix(name)}
    )


def column_counts(df: DataFrame) -> DataFrame:
    """(feature_name, n_values, contains_forbidden_token) per column: its values that are not null."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    rows = counts.unpivot([], df.columns, "feature_name", "n_values")
    return rows.withColumn("contains_forbidden_token", has_forbidden_prefix(F.col("feature_name")))


def manifest_match(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per condition: expected and actual feature counts, missing and extra names."""
    key = ["condition", "feature_name"]
    both = expected.select(*key).distinct().withColumn("e", F.lit(True)).join(
        actual.select(*key).distinct().withColumn("a", F.lit(True)), key, "full_outer")
    lacking = F.when(F.col("a").isNull(), F.col("feature_name"))
    extra = F.when(F.col("e").isNull(), F.col("feature_name"))
    return both.groupBy("condition").agg(
        F.count("e").alias("expected_feature_count"), F.count("a").alias("actual_feature_count"),
        F.array_join(F.array_sort(F.collect_list(lacking)), "|").alias("missing_features"),
        F.array_join(F.array_sort(F.collect_list(extra)), "|").alias("extra_features"),
        (F.count_if(F.col("a").isNull() | F.col("e").isNull()) == 0).alias("manifest_match"),
    )


def id_set_counts(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Sizes of the intersection, the differences and the union of two id sets."""
    sides = left.select(column).withColumns({"l": F.lit(1), "r": F.lit(0)}).unionByName(
        right.select(column).withColumns({"l": F.lit(0), "r": F.lit(1)}))
    ids = sides.groupBy(column).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return ids.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("n_both"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("n_left_only"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("n_right_only"),
        F.count(F.lit(1)).alias("n_either"),
    )


def protocol_table(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union of computed checks; each frame has one row (passed BOOLEAN, detail STRING)."""
    rows = [df.select(F.lit(name).alias("check"), "passed", "detail") for name, df in checks]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def headline_check(results: DataFrame, expected: dict[str, float], digits: int = 4) -> DataFrame:
    """Do published values (condition -> qwk) reappear in a result table, to some decimals?"""
    case = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    want = F.try_element_at(case, F.col("condition"))
    return results.filter(want.isNotNull()).select(
        "condition", F.round("qwk", digits).alias("qwk"), F.round(want, digits).alias("expected"),
        (F.round("qwk", digits) == F.round(want, digits)).alias("passed"))
