"""Audit of an annotation table: profile, consolidation, validation, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spandoc.functions.keyed import keyed_int
from spandoc.functions.scalar import joined_set
from spandoc.functions.text import char_count, strip_space, word_count
from spandoc.schemas import DEFAULT_SCHEME, LabelScheme

# Order of the exclusion flags in the joined reason, match statuses, and the
# thresholds of the audit classification.
EXCLUSION_FLAGS = (
    "conflicting_full_text",
    "conflicting_holistic_score",
    "missing_full_text",
    "missing_holistic_score",
    "missing_prompt",
    "no_discourse_annotations",
    "essay_in_multiple_splits",
)
MATCH_STATUSES = (
    "invalid_span",
    "outside_boundary",
    "exact_inclusive",
    "exact_exclusive",
    "strip_match_inclusive",
    "strip_match_exclusive",
    "discourse_text_trimmed",
    "mismatch",
)
PROCEED_SHARE = 0.95
EXCLUSIONS_SHARE = 0.85
# Spans of an entity that meet its text in one row, and entities above that whose number of rows is broadcast.
SPANS_PER_ROW = 10_000
BROADCAST_ENTITIES = 1_000_000


def profile(sources: dict[str, DataFrame], entity: str, important: list[str]) -> DataFrame:
    """Row, entity, duplicate and null counts per source and for all sources together.

    Duplicates are counted on a row digest, first grouped (with map-side combine) to one
    row per source and digest, so wide rows are hashed where they are read and never
    travel.  Two sources have the same columns here.
    """
    from spandoc.sources.tables import union_sources

    rows = union_sources(sources, "__src")
    names = [c for c in rows.columns if c != "__src"]
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in names]
    digest = F.md5(F.concat_ws("\u0001", *parts).cast("binary"))
    slim = rows.select(
        "__src", F.col(entity).cast("string").alias("__id"), digest.alias("__d"),
        *[F.col(c).isNull().cast("bigint").alias(f"__m_{c}") for c in important],
    )
    missing = [F.sum(f"__m_{c}").alias(f"__m_{c}") for c in important]
    # Equal rows share id and null pattern, so the counts survive the grouping.
    grouped = slim.groupBy("__src", "__id", "__d").agg(F.count(F.lit(1)).alias("__n"), *missing)

    def summary(groups: DataFrame, by: list[str]) -> DataFrame:
        per_id = groups.groupBy(*by, "__id").agg(
            F.sum("__n").alias("__n"), F.count(F.lit(1)).alias("__g"), *missing)
        return per_id.groupBy(*by).agg(
            F.sum("__n").alias("row_count"),
            F.count("__id").alias("entity_count"),
            (F.sum("__n") - F.sum("__g")).alias("duplicate_row_count"),
            *[F.sum(f"__m_{c}").alias(f"null_{c}") for c in important],
        )

    per_source = summary(grouped, ["__src"]).withColumnRenamed("__src", "source")
    combined = grouped.groupBy("__id", "__d").agg(F.sum("__n").alias("__n"), *missing)
    everything = summary(combined, []).withColumn("source", F.lit("combined"))
    unit = F.when(F.col("row_count") > F.col("entity_count"), "one row per span").otherwise("one row per entity")
    return per_source.unionByName(everything).withColumns(
        {"column_count": F.lit(len(names)).cast("bigint"), "row_unit": unit}
    )


def missing_as_json(profiled: DataFrame, important: list[str]) -> DataFrame:
    """Null counts of the important columns as one JSON cell."""
    entries = F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"null_{c}").alias("v")) for c in important])
    return profiled.withColumn("missing_values_json", F.to_json(F.map_from_entries(entries)))


def consolidate(rows: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """One row per entity from annotation rows.

    "First seen" needs an explicit order: (source_file, row_no).  The columns that carry texts are
    aggregated without collected sets, which would have every row sorted with its text: rows that come
    ordered by entity, as from a join by entity, then pass through once.  Sets and variant counts run over
    distinct narrow rows, where a digest stands for the text.
    """
    order = F.struct("source_file", "row_no")

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)

    annotated = F.col("label") != scheme.gap
    firsts = ("text", "score", "grp", "subgrp", "grade", "word_count_field")
    main = rows.groupBy("entity_id").agg(
        *[first(c) for c in firsts],
        F.count(F.lit(1)).alias("annotation_count"),
        F.count_if(annotated).alias("annotated_component_count"),
        F.coalesce(F.bool_or(annotated & F.col("effectiveness").isNotNull()), F.lit(False))
        .alias("has_effectiveness_labels"),
    )
    # The filter keeps Spark from dropping this grouping in favour of the next one.
    slim = rows.groupBy("entity_id", "split", "source_file", F.md5(F.col("text").cast("binary")).alias("t"), "score").agg(
        F.count(F.lit(1)).alias("n")).filter("n > 0")
    sets = slim.groupBy("entity_id").agg(
        joined_set(F.col("split")).alias("split"),
        joined_set(F.col("source_file")).alias("source_files"),
        F.count_distinct("t").alias("text_variant_count"),
        F.count_distinct("score").alias("score_variant_count"),
    )
    return main.join(sets, "entity_id").select(
        "entity_id", *firsts, "split", "source_files", "annotation_count", "annotated_component_count",
        "has_effectiveness_labels", "text_variant_count", "score_variant_count")


def validate_entities(entities: DataFrame) -> DataFrame:
    """Presence flags, exclusion reasons and the conjunction ``join_valid`` per entity."""

    def filled(c: str) -> Column:
        return strip_space(F.coalesce(F.col(c), F.lit(""))) != ""

    flagged = entities.withColumns(
        {
            "has_full_text": filled("text"),
            "has_holistic_score": F.col("score").isNotNull(),
            "has_prompt": filled("grp"),
            "has_discourse_annotations": F.col("annotated_component_count") > 0,
        }
    )
    flags = dict(
        zip(
            EXCLUSION_FLAGS,
            (
                F.col("text_variant_count") > 1,
                F.col("score_variant_count") > 1,
                ~F.col("has_full_text"),
                ~F.col("has_holistic_score"),
                ~F.col("has_prompt"),
                ~F.col("has_discourse_annotations"),
                F.col("split").contains("|"),
            ),
        )
    )
    reason = F.concat_ws(";", *[F.when(cond, F.lit(name)) for name, cond in flags.items()])
    return flagged.withColumns(
        {"exclusion_reason": reason, "join_valid": reason == ""}
    ).select(
        "entity_id", "has_full_text", "has_holistic_score", "has_prompt", "has_discourse_annotations",
        "has_effectiveness_labels", "annotation_count", "annotated_component_count", "join_valid",
        "exclusion_reason", "split", "grp", "score",
    )


def span_match_status(text_length: Column, sliced: Column, start: Column, end: Column, quoted: Column) -> Column:
    """How a quoted span text relates to the slice of the text it points at (first match wins).

    ``sliced`` is the slice with its last character included.
    """
    quoted = F.coalesce(quoted, F.lit(""))
    shorter = F.substring(sliced, F.lit(1), F.length(sliced) - 1)
    names = iter(MATCH_STATUSES)
    return (
        F.when((start < 0) | (end < start), next(names))
        .when(end >= text_length, next(names))
        .when(sliced == quoted, next(names))
        .when(shorter == quoted, next(names))
        .when(strip_space(sliced) == strip_space(quoted), next(names))
        .when(strip_space(shorter) == strip_space(quoted), next(names))
        .when((quoted != "") & sliced.contains(quoted), next(names))
        .otherwise(next(names))
    )


def _dealt(annotated: DataFrame) -> DataFrame:
    """``annotated`` with a slot, of about SPANS_PER_ROW spans of an entity at most; one slot unless an entity has more."""
    counts = annotated.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPANS_PER_ROW)
    crowded = counts.select("entity_id", F.ceil(F.col("n") / SPANS_PER_ROW).alias("slots"))
    n = crowded.count()
    if not n:
        return annotated.withColumn("slot", F.lit(0).cast("bigint"))
    if n <= BROADCAST_ENTITIES:
        crowded = F.broadcast(crowded)
    slot = F.pmod(F.xxhash64("k", "start_at", "end_at"), F.coalesce("slots", F.lit(1)))
    return annotated.join(crowded, "entity_id", "left").withColumn("slot", slot).drop("slots")


def match_statuses(spans: DataFrame, texts: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """Annotated spans with their text length and match status.

    Texts never travel with the spans: the borders of an entity's spans meet its one text row,
    and only the slices go on.  Entities of more than SPANS_PER_ROW spans are dealt over several such rows,
    so no row or task holds all spans of an entity.
    """
    annotated = spans.filter(F.col("label") != scheme.gap).select("entity_id", "k", "start_at", "end_at", "span_text")
    borders = _dealt(annotated).groupBy("entity_id", "slot").agg(
        F.collect_list(F.struct("k", "start_at", "end_at", "span_text")).alias("spans"))
    met = borders.join(texts.select("entity_id", F.coalesce("text", F.lit("")).alias("text")), "entity_id", "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = met.select("entity_id", text.alias("text"), F.length(text).cast("bigint").alias("text_length"), "spans")
    cut = F.transform("spans", lambda s: F.struct(s.alias("s"), F.substring(
        F.col("text"), (s["start_at"] + 1).cast("int"), (s["end_at"] - s["start_at"] + 1).cast("int")).alias("sliced")))
    return rows.select("entity_id", "text_length", F.inline(cut)).select(
        "entity_id", "s.k", "s.start_at", "s.end_at", "text_length",
        span_match_status(F.col("text_length"), F.col("sliced"), F.col("s.start_at"), F.col("s.end_at"), F.col("s.span_text")).alias("status"))


def match_histogram(spans: DataFrame, texts: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME,
                    fraction: float | None = None, seed: int = 42) -> DataFrame:
    """Spans per match status; with ``fraction`` a sample is scaled up, except for
    ``outside_boundary``, which stays exact.  The sample is a keyed draw per span, the same on any partitioning."""
    if fraction is None:
        return match_statuses(spans, texts, scheme).groupBy("status").agg(F.count(F.lit(1)).alias("n_spans"))
    lengths = texts.select("entity_id", F.length("text").alias("n"))
    annotated = spans.filter(F.col("label") != scheme.gap)
    outside = annotated.join(lengths, "entity_id", "left").agg(
        F.lit("outside_boundary").alias("status"),
        F.count_if(F.col("end_at") >= F.coalesce(F.col("n"), F.lit(0))).alias("n_spans"),
    )
    drawn = keyed_int(seed, "sample", F.col("entity_id"), F.col("k")) < int(fraction * 2**32)
    sampled = match_statuses(annotated.filter(drawn), texts, scheme)
    scaled = sampled.filter(F.col("status") != "outside_boundary").groupBy("status").agg(
        F.floor(F.count(F.lit(1)) / F.lit(float(fraction))).cast("bigint").alias("n_spans"))
    return outside.unionByName(scaled)


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Counts per value; NULL is a group of its own."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def label_set_check(spans: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """Labels outside the scheme and scheme labels that never occur."""
    present = spans.select("label").distinct().filter(F.col("label").isNotNull())
    known = F.array(*[F.lit(x) for x in scheme.labels])
    seen = present.agg(F.array_sort(F.collect_set("label")).alias("seen"))
    return seen.select(
        F.array_join(F.array_except("seen", F.concat(known, F.array(F.lit(scheme.gap)))), "|").alias("unexpected"),
        F.array_join(F.array_sort(F.array_except(known, "seen")), "|").alias("missing"),
    )


def score_distribution(entities: DataFrame) -> DataFrame:
    """Entities per score with percentage of the scored entities."""
    counts = entities.filter(F.col("score").isNotNull()).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # one row per score value
    return counts.withColumn("percentage", F.round(F.col("n") / F.sum("n").over(everything) * 100, 4))


def group_score_counts(entities: DataFrame) -> DataFrame:
    """Counts per (group, score) and per (subgroup, score) in one pass."""
    sides = F.array(
        F.struct(F.lit("grp").alias("level"), F.col("grp").alias("name")),
        F.struct(F.lit("subgrp").alias("level"), F.col("subgrp").alias("name")),
    )
    counts = entities.groupBy("grp", "subgrp", "score").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.select(F.explode(sides).alias("s"), "score", "n")
        .filter(F.col("s.name").isNotNull() & F.col("score").isNotNull())
        .groupBy(F.col("s.level").alias("level"), F.col("s.name").alias("name"), "score")
        .agg(F.sum("n").alias("n"))
    )


def group_inventory(entities: DataFrame, subgroups: list[str]) -> DataFrame:
    """One row per group: size, subgroups, conditional counts, grades, score range and histogram."""
    cells = entities.groupBy("grp", "subgrp", "grade", "score").agg(F.count(F.lit(1)).alias("n"))
    by_score = (
        cells.filter(F.col("score").isNotNull()).groupBy("grp", "score").agg(F.sum("n").alias("n"))
        .groupBy("grp").agg(
            F.to_json(F.map_from_entries(F.array_sort(F.collect_list(
                F.struct(F.col("score").cast("bigint").cast("string").alias("k"), F.col("n").alias("v"))))))
            .alias("score_distribution_json"))
        .withColumnRenamed("grp", "__g")
    )
    grades = F.array_sort(F.collect_set("grade"))
    head = cells.groupBy("grp").agg(
        F.sum("n").alias("entity_count"),
        joined_set(F.col("subgrp")).alias("subgroups"),
        *[F.sum(F.when(F.col("subgrp") == s, F.col("n")).otherwise(0)).alias(f"count_{s}") for s in subgroups],
        F.array_join(F.transform(grades, lambda g: g.cast("string")), "|").alias("grades"),
        F.min("score").alias("score_min"), F.max("score").alias("score_max"),
        joined_set(F.col("score").cast("bigint")).alias("unique_scores"),
    )
    return head.join(by_score, F.col("grp").eqNullSafe(F.col("__g")), "left").drop("__g")


def structure_statistics(entities: DataFrame, spans: DataFrame, validation: DataFrame | None = None,
                         scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """Per entity: sizes, coverage, component count, diversity and label presence."""
    annotated = F.col("label") != scheme.gap
    has = {f"has_{scheme.key(x).lower()}": F.bool_or(F.col("label") == x) for x in scheme.labels}
    agg = spans.groupBy("entity_id").agg(
        F.sum(F.col("end_at") - F.col("start_at") + 1).alias("covered_chars"),
        F.count_if(annotated).alias("component_count"),
        F.size(F.collect_set(F.when(annotated, F.col("label")))).cast("bigint").alias("label_diversity"),
        *[c.alias(n) for n, c in has.items()],
    )
    sizes = entities.select(
        "entity_id", "score", "grp", "subgrp",
        *([char_count(F.col("text")).alias("char_count"), word_count(F.col("text")).alias("word_count")]
          if "text" in entities.columns else ["char_count"]),
    )
    out = sizes.join(agg, "entity_id", "left").withColumns(
        {
            "component_count": F.coalesce("component_count", F.lit(0)),
            "label_diversity": F.coalesce("label_diversity", F.lit(0)),
            "coverage_pct": F.round(
                F.try_divide(F.col("covered_chars").cast("double"), F.nullif(F.col("char_count"), F.lit(0))) * 100, 4),
            **{n: F.coalesce(n, F.lit(False)) for n in has},
        }
    ).drop("covered_chars")
    if validation is not None:
        out = out.join(validation.select("entity_id", "join_valid"), "entity_id", "left")
    return out


def structure_by_score(statistics: DataFrame, flags: list[str]) -> DataFrame:
    """Mean sizes and label shares of the valid entities per score."""
    valid = statistics.filter("join_valid") if "join_valid" in statistics.columns else statistics
    return valid.groupBy("score").agg(
        F.count(F.lit(1)).alias("entities"),
        F.avg("word_count").alias("mean_word_count"),
        F.avg("component_count").alias("mean_components"),
        *[F.avg(F.col(f).cast("int")).alias(f"pct_{f.removeprefix('has_')}") for f in flags],
    )


def audit_summary(validation: DataFrame, entities: DataFrame, statuses: DataFrame) -> DataFrame:
    """One row of headline counters and the PROCEED classification."""
    v = validation.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("join_valid").alias("valid"),
        F.count_if(F.col("has_full_text") & F.col("has_holistic_score") & F.col("has_discourse_annotations"))
        .alias("complete"),
        F.count_if(F.col("split").contains("|")).alias("multi_split"),
    )
    e = entities.agg(F.count_if(F.col("text_variant_count") > 1).alias("conflicting_text"))
    s = statuses.agg(F.count_if(F.col("end_at") >= F.col("text_length")).alias("outside"))
    one = v.withColumn("j", F.lit(1)).join(e.withColumn("j", F.lit(1)), "j").join(s.withColumn("j", F.lit(1)), "j")
    problems = (F.col("conflicting_text") > 0) | (F.col("multi_split") > 0) | (F.col("outside") > 0)
    valid_share, complete_share = F.col("valid") / F.col("total"), F.col("complete") / F.col("total")
    strong = (valid_share >= PROCEED_SHARE) & (complete_share >= PROCEED_SHARE)
    verdict = (
        F.when(strong & ~problems, "PROCEED")
        .when(strong | (valid_share >= EXCLUSIONS_SHARE), "PROCEED WITH EXCLUSIONS")
        .otherwise("DO NOT PROCEED")
    )
    return one.drop("j").withColumn("classification", verdict)


def top_reasons(validation: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent exclusion reasons (a top-k report)."""
    return (
        validation.filter(~F.col("join_valid")).groupBy("exclusion_reason").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "exclusion_reason").limit(k)
    )
