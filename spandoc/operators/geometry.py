"""Geometry of ordered spans: partition, overlap, duplicate and order checks.

Every check is a mergeable aggregate over rows that know their next neighbour, so an
entity of any length is folded by partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spandoc.operators.ordered import Ordered, cut_hot, neighbours
from spandoc.schemas import DEFAULT_SCHEME, SPAN_ORDER, LabelScheme


def with_next_spans(spans: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME, whole: bool = True) -> DataFrame:
    """Spans with their neighbours.

    ``rank`` counts within the annotated (or within the gap) spans of the entity;
    ``next_start`` / ``next_label`` belong to the next span of that same kind.  With
    ``whole`` also ``all_start`` / ``all_label``, the next span of the full list.
    """
    base = spans.select("entity_id", "k", "start_at", "end_at", "label").withColumn(
        "is_gap", F.col("label").eqNullSafe(scheme.gap)
    )
    cut = cut_hot(base, "entity_id", SPAN_ORDER)
    return next_spans(cut, whole).finish()


def next_spans(cut: Ordered, whole: bool = True) -> Ordered:
    if whole:
        cut = neighbours(cut, SPAN_ORDER, lead={"all_start": "start_at", "all_label": "label"})
    return neighbours(
        cut, SPAN_ORDER, within=["is_gap"], row_number="rank",
        lead={"next_start": "start_at", "next_label": "label"},
    )


def partition_status(spans: DataFrame, entities: DataFrame, bounds: str = "extent") -> DataFrame:
    """Do the spans of each entity tile its text?

    ``bounds='extent'`` compares min(start) and max(end) and knows ``missing_text``;
    ``bounds='last'`` looks at the end of the last span in (start, end) order and knows
    ``no_spans``.  Gap spans take part in both.
    """
    cut = cut_hot(spans.select("entity_id", "k", "start_at", "end_at", "label"), "entity_id", SPAN_ORDER)
    nxt = neighbours(cut, SPAN_ORDER, lead={"all_start": "start_at"}).finish()
    is_last = F.col("all_start").isNull()
    agg = nxt.groupBy("entity_id").agg(
        F.min("start_at").alias("start_min"), F.max("end_at").alias("end_max"),
        F.max(F.when(is_last, F.col("end_at"))).alias("last_end"),
        F.count_if(F.col("end_at") + 1 != F.col("all_start")).alias("breaks"),
    )
    joined = entities.select("entity_id", "char_count").join(agg, "entity_id", "left")
    return joined.select("entity_id", "start_min", "end_max", "char_count", _tiling(bounds).alias("partition_status"))


def _tiling(bounds: str = "extent") -> Column:
    """Partition status from char_count, start_min, end_max or last_end, and breaks."""
    n = F.coalesce(F.col("char_count"), F.lit(0))
    if bounds == "extent":
        status = F.when(n == 0, "missing_text").when(F.col("start_min").isNull(), "no_spans")
        end = F.col("end_max")
    elif bounds == "last":
        status = F.when(F.col("start_min").isNull(), "no_spans")
        end = F.col("last_end")
    else:
        raise ValueError(f"unknown bounds mode {bounds!r}")
    return (
        status.when(F.col("start_min") != 0, "does_not_start_at_zero")
        .when(end != n - 1, "does_not_end_at_last_char")
        .when(F.col("breaks") > 0, "gap_or_overlap")
        .otherwise("complete_partition")
    )


def segment_stats(spans: DataFrame, entities: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    agg = spans.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("total_segments"),
        F.count_if(F.col("label") == scheme.gap).alias("unannotated_segments"),
        F.min("start_at").alias("start_min"), F.max("end_at").alias("end_max"),
    )
    return agg.join(entities.select("entity_id", F.col("char_count").alias("text_length")), "entity_id", "left").withColumn(
        "annotated_segments", F.col("total_segments") - F.col("unannotated_segments")
    )


def duplicate_spans(spans: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """Number of (start, end, label) keys that occur more than once, per entity."""
    keys = (
        spans.filter(F.col("label") != scheme.gap)
        .groupBy("entity_id", "start_at", "end_at", "label").agg(F.count(F.lit(1)).alias("n"))
    )
    return keys.filter(F.col("n") > 1).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("duplicate_annotations"))


def overlap_pairs(spans: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """Adjacent annotated spans (in start, end order) whose offsets overlap, per entity."""
    annotated = spans.select("entity_id", "k", "start_at", "end_at", "label").filter(F.col("label") != scheme.gap)
    cut = cut_hot(annotated, "entity_id", SPAN_ORDER)
    nxt = neighbours(cut, SPAN_ORDER, lead={"next_start": "start_at"}).finish()
    return nxt.groupBy("entity_id").agg(
        F.count_if(F.col("end_at") >= F.col("next_start")).alias("overlap_pairs"))


def order_heuristic(spans: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """Is a single lead first, a single closing last, and the first position before the first claim?"""
    nxt = with_next_spans(spans.filter(F.col("label") != scheme.gap), scheme, whole=False)
    return nxt.groupBy("entity_id").agg(_order_is_expected(scheme).alias("order_valid"))


def _order_is_expected(scheme: LabelScheme) -> Column:
    label, rank = F.col("label"), F.col("rank")

    def misplaced(role: str, at_edge: Column) -> Column:
        return (F.count_if(label == role) == 1) & (F.count_if((label == role) & at_edge) == 0)

    late_position = (
        F.min(F.when(label == scheme.position, rank)) > F.min(F.when(label == scheme.claim, rank))
    )
    return ~(
        misplaced(scheme.lead, rank == 1)
        | misplaced(scheme.closing, F.col("next_label").isNull())
        | F.coalesce(late_position, F.lit(False))
    )


def order_matches_ordinal(spans: DataFrame, ordinal: str = "k", scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """Does reading the spans by start give the same label sequence as reading them by ordinal?

    Both sequences are ranked and met on (entity, rank): equal positions, not equal arrays.
    """
    ann = spans.select("entity_id", "start_at", "end_at", "label", "k", F.col(ordinal).alias("ord")).filter(
        F.col("label") != scheme.gap)
    by_start = neighbours(cut_hot(ann, "entity_id", SPAN_ORDER), SPAN_ORDER, row_number="rank").finish()
    by_ord = neighbours(
        cut_hot(ann, "entity_id", ["ord", "label"]), ["ord", "label"], row_number="rank").finish()
    met = by_start.select("entity_id", "rank", F.col("label").alias("a")).join(
        by_ord.select("entity_id", "rank", F.col("label").alias("b")), ["entity_id", "rank"])
    return met.groupBy("entity_id").agg((F.count_if(F.col("a") != F.col("b")) == 0).alias("order_matches"))


def missing_labels(spans: DataFrame, entities: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """Scheme labels that an entity lacks, sorted and ``|``-joined."""
    has = {x: F.bool_or(F.col("label") == x).alias(f"has_{i}") for i, x in enumerate(scheme.labels)}
    agg = spans.groupBy("entity_id").agg(*has.values())
    return entities.select("entity_id").join(agg, "entity_id", "left").select("entity_id", _lacking(scheme).alias("missing_labels"))


def _lacking(scheme: LabelScheme) -> Column:
    """Labels without a true ``has_<i>`` column, sorted and joined."""
    return F.concat_ws("|", *[
        F.when(~F.coalesce(F.col(f"has_{i}"), F.lit(False)), F.lit(x))
        for x, i in sorted((x, i) for i, x in enumerate(scheme.labels))])


def annotation_issues(spans: DataFrame, entities: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME,
                      ordinal: str = "k") -> DataFrame:
    """All geometry findings of an entity in one row.

    All but the duplicates and the comparison with the ordinal are aggregates of one ordered table.
    """
    base = spans.select("entity_id", "k", "start_at", "end_at", "label").withColumn(
        "is_gap", F.coalesce(F.col("label") == scheme.gap, F.lit(True)))
    nxt = next_spans(cut_hot(base, "entity_id", SPAN_ORDER)).finish()
    agg = nxt.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("total_segments"), F.count_if(F.col("label") == scheme.gap).alias("unannotated_segments"),
        F.min("start_at").alias("start_min"), F.max("end_at").alias("end_max"),
        F.count_if(F.col("end_at") + 1 != F.col("all_start")).alias("breaks"),
        F.count_if(~F.col("is_gap") & (F.col("end_at") >= F.col("next_start"))).alias("overlap_pairs"),
        _order_is_expected(scheme).alias("order_valid"),
        *[F.bool_or(F.col("label") == x).alias(f"has_{i}") for i, x in enumerate(scheme.labels)])
    known = entities.select("entity_id", "char_count", F.lit(True).alias("known"))
    out = agg.join(known, "entity_id", "left")
    for extra in (order_matches_ordinal(spans, ordinal, scheme), duplicate_spans(spans, scheme)):
        out = out.join(extra, "entity_id", "left")
    annotated = F.col("total_segments") - F.col("unannotated_segments")
    return out.select(
        "entity_id", "total_segments", "unannotated_segments", "start_min", "end_max", F.col("char_count").alias("text_length"),
        annotated.alias("annotated_segments"), F.when(F.col("known"), _tiling()).alias("partition_status"), "order_valid",
        F.coalesce("order_matches", F.lit(False)).alias("order_matches"),
        F.coalesce("duplicate_annotations", F.lit(0)).alias("duplicate_annotations"), "overlap_pairs",
        F.when(F.col("known"), _lacking(scheme)).alias("missing_labels"), (annotated == 0).alias("has_no_annotations"))
