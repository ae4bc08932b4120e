"""Exemplar entities by strata, and their readable span listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from spandoc.functions.scalar import relative_position
from spandoc.operators.geometry import overlap_pairs, partition_status, segment_stats
from spandoc.schemas import DEFAULT_SCHEME, SCORE_MAX, SCORE_MIN, LabelScheme

# How many entities each stratum contributes and how many are wanted at least.
GROUPS_WANTED = 8
PER_SUBGROUP = 2
COMPLEX_SPANS, COMPLEX_TAKE = 8, 3
SIMPLE_SPANS, SIMPLE_TAKE = 4, 2
BAD_PARTITION_TAKE = 3
OVERLAP_TAKE = 2
WANTED = 20
PREVIEW_CHARS = 120
# Strata up to this priority pass over ids that are taken; later ones only look at their first ids.
GREEDY_PRIORITY = 3


def issue_columns(spans: DataFrame, entities: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    seg = segment_stats(spans, entities, scheme).select("entity_id", "annotated_segments")
    return (
        partition_status(spans, entities).select("entity_id", "partition_status")
        .join(seg, "entity_id", "left").join(overlap_pairs(spans, scheme), "entity_id", "left")
        .na.fill(0, ["annotated_segments", "overlap_pairs"])
    )


def select_exemplars(entities: DataFrame, issues: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """Entities picked stratum by stratum in a fixed order, filled up to 20: entity_id, priority, stratum.

    Scores, groups and subgroups (each in the order of their values) take their first ids that no stratum
    before them has picked.  The strata of issues (complex, simple, bad partition, overlapping) look at
    their first ids only and leave out those picked before.  ``valid`` (entity_id) restricts the entities that
    fill up; by default all do.

    A stratum can lose no more ids to the strata before it than these take, so it keeps that many
    and its own; what is left is resolved in order by one fold.  Ids are first cut per stratum and id bucket, so no
    stratum, however large, is sorted in one task.
    """
    groups = F.broadcast(entities.select("grp").distinct().orderBy("grp").limit(GROUPS_WANTED)
                         .withColumn("wanted_grp", F.lit(True)))
    e = entities.select("entity_id", "score", "grp", "subgrp").join(groups, "grp", "left").join(issues, "entity_id", "left")
    fills = entities if valid is None else valid
    e = e.join(fills.select("entity_id").distinct().withColumn("fills", F.lit(True)), "entity_id", "left")

    def stratum(priority, name, take, cond):
        return F.when(cond, F.struct(F.lit(priority).alias("priority"), name.alias("stratum"), F.lit(take).alias("take")))

    strata = F.array_compact(F.array(
        stratum(1, F.concat(F.lit("score="), F.col("score")), 1, F.col("score").between(SCORE_MIN, SCORE_MAX)),
        stratum(2, F.concat(F.lit("grp="), F.col("grp")), 1, F.col("wanted_grp")),
        stratum(3, F.concat(F.lit("subgrp="), F.col("subgrp")), PER_SUBGROUP, F.col("subgrp").isNotNull()),
        stratum(4, F.lit("complex"), COMPLEX_TAKE, F.col("annotated_segments") >= COMPLEX_SPANS),
        stratum(5, F.lit("simple"), SIMPLE_TAKE, F.col("annotated_segments") <= SIMPLE_SPANS),
        stratum(6, F.lit("bad_partition"), BAD_PARTITION_TAKE, F.col("partition_status") != "complete_partition"),
        stratum(7, F.lit("overlapping"), OVERLAP_TAKE, F.col("overlap_pairs") > 0),
        stratum(8, F.lit("fill"), WANTED, F.col("fills")),
    ))
    rows = e.select("entity_id", F.explode(strata).alias("s")).select("entity_id", "s.*")
    # One row per stratum: how many ids it has to keep.
    names = rows.select("priority", "stratum", "take").distinct()
    before = F.coalesce(F.sum("take").over(Window.orderBy("priority", "stratum").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = names.withColumn("keep", F.col("take") + F.when(F.col("priority") <= GREEDY_PRIORITY, before).otherwise(0))
    rows = rows.join(F.broadcast(names.select("stratum", "keep")), "stratum").withColumn(
        "bucket", F.pmod(F.xxhash64("entity_id"), F.lit(4096)))
    per_bucket = Window.partitionBy("stratum", "bucket").orderBy("entity_id")
    per_stratum = Window.partitionBy("stratum").orderBy("entity_id")
    short = rows.withColumn("rn", F.row_number().over(per_bucket)).filter("rn <= keep")
    kept = short.withColumn("rn", F.row_number().over(per_stratum)).filter("rn <= keep")
    lists = kept.groupBy("priority", "stratum", "take").agg(F.array_sort(F.collect_list("entity_id")).alias("ids"))
    ordered = lists.agg(F.array_sort(F.collect_list(F.struct("priority", "stratum", "take", "ids"))).alias("strata"))
    nothing = "cast(array() AS array<struct<entity_id:string,priority:int,stratum:string>>)"
    unused = "filter({ids}, i -> NOT exists(acc, p -> p.entity_id = i))"
    new = (f"CASE WHEN s.priority = 8 THEN slice({unused.format(ids='s.ids')}, 1, greatest(0, s.take - size(acc))) "
           f"ELSE slice({unused.format(ids='s.ids')}, 1, s.take) END")
    fold = (f"aggregate(strata, {nothing}, (acc, s) -> concat(acc, transform({new}, i -> "
            "named_struct('entity_id', i, 'priority', s.priority, 'stratum', s.stratum))))")
    return ordered.select(F.explode(F.expr(fold)).alias("p")).select("p.*")


def render(selected: DataFrame, spans: DataFrame, entities: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME,
           issues: DataFrame | None = None) -> DataFrame:
    """One row per annotated span of the selected documents: place, preview and label path, the document's score,
    and with ``issues`` its partition status and overlapping pairs; with an ``effectiveness`` column in ``spans`` that too.

    The selected handful are documents, whose span list is bounded by one text cell.
    """
    few = F.broadcast(selected.select("entity_id", "priority", "stratum"))
    ann = spans.filter(F.col("label") != scheme.gap).join(few, "entity_id").join(
        entities.select("entity_id", "char_count", "score"), "entity_id")
    more = ["score"]
    if issues is not None:
        ann = ann.join(issues.select("entity_id", "partition_status", "overlap_pairs"), "entity_id", "left")
        more += ["partition_status", "overlap_pairs"]
    more += ["effectiveness"] if "effectiveness" in spans.columns else []
    by_start = Window.partitionBy("entity_id").orderBy("start_at", "end_at", "label", "k")
    whole = by_start.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    quoted = F.coalesce("span_text", F.lit(""))
    preview = F.concat(
        F.replace(F.substring(quoted, 1, PREVIEW_CHARS), F.lit("\n"), F.lit(" ")),
        F.when(F.length(quoted) > PREVIEW_CHARS, "...").otherwise(""),
    )
    return ann.select(
        "entity_id", "priority", "stratum", F.row_number().over(by_start).cast("bigint").alias("position"),
        "label", "start_at", "end_at",
        relative_position(F.col("start_at"), F.col("end_at"), F.col("char_count")).alias("relative_range"),
        preview.alias("preview"),
        F.array_join(F.collect_list("label").over(whole), " → ").alias("label_path"), *more,
    )
