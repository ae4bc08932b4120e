"""Structure features of ordered spans: counts, order, label positions, boundary geometry.

All families are mergeable aggregates over spans that know their neighbour, so any set of
families costs one aggregation by entity, whatever the entity's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spandoc.functions.text import surface_columns
from spandoc.operators.geometry import with_next_spans
from spandoc.operators.tfidf import arrays_pairs
from spandoc.schemas import DEFAULT_SCHEME, LabelScheme
from spandoc.sources.tables import span_lists

# Families a caller can ask for; "geometry" and "boundary_only" need max_ranks.
FAMILIES = ("surface", "count", "firstlast", "transition", "label_position", "geometry", "boundary_only")
# A wide table with more rank slots than this is refused; rank_slots() has no such bound.
MAX_WIDE_RANKS = 1000


def max_rank_count(spans: DataFrame, train: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME) -> int:
    """Largest number of annotated spans of a training entity (fixes the rank slots)."""
    counts = (
        spans.filter(F.col("label") != scheme.gap).join(train.select("entity_id"), "entity_id", "left_semi")
        .groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    )
    return int(counts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])


# Families are written as SQL expressions: the widest condition has hundreds of them, and one
# parsed string each is much cheaper to plan than nested Column calls.
def _quoted(label: str) -> str:
    return "'" + label.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _zero(name: str) -> str:
    return f"coalesce(cast({name} AS DOUBLE), 0D)"


def _share(part: str, whole: str) -> str:
    return f"{part} / greatest({whole}, 1D)"


TEXT_LENGTH = "greatest(coalesce(cast(char_count AS DOUBLE), 0D), 1D)"


def _count_family(scheme: LabelScheme):
    raw = {
        "c_ann": "count_if(NOT is_gap)", "c_all": "count(1)", "c_gap": "count_if(is_gap)",
        "c_cov": "sum(end_at - start_at + 1)",
        **{f"c_{i}": f"count_if(label = {_quoted(t)})" for i, t in enumerate(scheme.labels)},
    }
    n_ann, n_all = _zero("c_ann"), _zero("c_all")
    final = {
        "count_total_components": n_ann,
        "count_total_segments": n_all,
        "count_annotation_coverage": f"{_zero('c_cov')} / {TEXT_LENGTH}",
        "count_unannotated_gaps": _zero("c_gap"),
        "count_unannotated_proportion": _share(_zero("c_gap"), n_all),
    }
    for i, t in enumerate(scheme.labels):
        final[f"count_{scheme.key(t)}"] = _zero(f"c_{i}")
        final[f"prop_{scheme.key(t)}"] = _share(_zero(f"c_{i}"), n_ann)
    return raw, final


def _firstlast_family(scheme: LabelScheme):
    raw, final = {}, {}
    for i, t in enumerate(scheme.labels):
        raw[f"f_{i}"] = f"count_if(label = {_quoted(t)} AND rank = 1)"
        raw[f"l_{i}"] = f"count_if(label = {_quoted(t)} AND next_label IS NULL)"
        final[f"order_first_is_{scheme.key(t)}"] = _zero(f"f_{i}")
        final[f"order_final_is_{scheme.key(t)}"] = _zero(f"l_{i}")
    return raw, final


def _transition_family(scheme: LabelScheme):
    raw = {"t_n": "count_if(NOT is_gap)"}
    final = {}
    for i, a in enumerate(scheme.labels):
        for j, b in enumerate(scheme.labels):
            raw[f"t_{i}_{j}"] = f"count_if(label = {_quoted(a)} AND next_label = {_quoted(b)})"
            final[f"order_trans_{scheme.key(a)}__{scheme.key(b)}"] = _share(_zero(f"t_{i}_{j}"), f"{_zero('t_n')} - 1")
    return raw, final


def _label_position_family(scheme: LabelScheme):
    raw, final = {}, {}
    mid = "cast(start_at + end_at AS DOUBLE) / 2"
    for i, t in enumerate(scheme.labels):
        here = f"label = {_quoted(t)}"
        raw[f"p_mean{i}"] = f"avg(CASE WHEN {here} THEN {mid} END)"
        raw[f"p_std{i}"] = f"stddev_pop(CASE WHEN {here} THEN {mid} END)"
        raw[f"p_first{i}"] = f"min_by({mid}, CASE WHEN {here} THEN rank END)"
        raw[f"p_final{i}"] = f"max_by({mid}, CASE WHEN {here} THEN rank END)"
        for part in ("mean", "first", "final", "std"):
            final[f"order_{part}_pos_{scheme.key(t)}"] = f"{_zero(f'p_{part}{i}')} / {TEXT_LENGTH}"
    return raw, final


def _boundary_family(scheme: LabelScheme, max_ranks: int):
    if max_ranks > MAX_WIDE_RANKS:
        raise ValueError(f"{max_ranks} rank slots are too wide for a table; use rank_slots()")
    size = "CASE WHEN NOT is_gap THEN cast(end_at - start_at + 1 AS DOUBLE) END"
    # Holes count twice by design: in the full list next to a gap span, and between
    # annotated neighbours, where a gap span itself is a hole.
    hole_a = (f"CASE WHEN (is_gap OR all_label <=> {_quoted(scheme.gap)}) AND all_start - end_at > 1 "
              "THEN cast(all_start - end_at - 1 AS DOUBLE) END")
    hole_b = "CASE WHEN NOT is_gap AND next_start - end_at > 1 THEN cast(next_start - end_at - 1 AS DOUBLE) END"

    def both(pattern: str) -> str:
        return " + ".join(f"coalesce({pattern.format(h=h)}, 0D)" for h in (hole_a, hole_b))

    raw = {
        "b_mean": f"avg({size})", "b_std": f"stddev_pop({size})", "b_min": f"min({size})", "b_max": f"max({size})",
        "g_n": f"count({hole_a}) + count({hole_b})",
        "g_s": both("sum({h})"), "g_q": both("sum(power({h}, 2))"),
        "g_x": f"greatest(max({hole_a}), max({hole_b}))",
        "g_p": both("sum(CASE WHEN {h} IS NOT NULL THEN cast(end_at + 1 AS DOUBLE) END)"),
    }
    if max_ranks:
        # At most max_ranks borders per entity, collected once instead of tested per slot.
        raw["slots"] = (f"array_sort(collect_list(CASE WHEN NOT is_gap AND rank <= {max_ranks} "
                        "THEN struct(rank, start_at, end_at + 1 AS stop) END))")
    final = {}
    for i in range(max_ranks):
        final[f"pos_start_rank_{i}"] = f"{_zero(f'get(slots, {i}).start_at')} / {TEXT_LENGTH}"
        final[f"pos_end_rank_{i}"] = f"{_zero(f'get(slots, {i}).stop')} / {TEXT_LENGTH}"
    for part in ("mean", "std", "min", "max"):
        final[f"pos_len_{part}"] = f"{_zero(f'b_{part}')} / {TEXT_LENGTH}"
    n = _zero("g_n")
    mean = _share(_zero("g_s"), n)
    var = f"greatest({_share(_zero('g_q'), n)} - power({mean}, 2), 0D)"
    final["pos_gap_count"] = n
    final["pos_gap_len_mean"] = f"{mean} / {TEXT_LENGTH}"
    final["pos_gap_len_std"] = f"CASE WHEN {n} > 1 THEN sqrt({var}) / {TEXT_LENGTH} ELSE 0D END"
    final["pos_gap_len_max"] = f"{_zero('g_x')} / {TEXT_LENGTH}"
    final["pos_gap_pos_mean"] = f"{_share(_zero('g_p'), n)} / {TEXT_LENGTH}"
    return raw, final


def structure_features(
    spans: DataFrame,
    entities: DataFrame,
    families: tuple[str, ...],
    scheme: LabelScheme = DEFAULT_SCHEME,
    max_ranks: int = 0,
) -> DataFrame:
    """Wide feature table, one row per entity, feature columns sorted by name.

    ``spans`` is a span table, or the output of ``with_next_spans``.  Entities without
    spans get zeros.  ``surface`` needs a ``text`` column in ``entities``.
    """
    unknown = set(families) - set(FAMILIES)
    if unknown:
        raise ValueError(f"unknown feature families {sorted(unknown)}")
    raw: dict[str, str] = {}
    final: dict[str, str] = {}
    surface: dict[str, Column] = {}
    for family in families:
        if family == "surface":
            surface = surface_columns(F.coalesce(F.col("text"), F.lit("")))
            continue
        if family == "count":
            r, f = _count_family(scheme)
        elif family == "firstlast":
            r, f = _firstlast_family(scheme)
        elif family == "transition":
            r, f = _transition_family(scheme)
        elif family == "label_position":
            r, f = _label_position_family(scheme)
        else:
            r, f = _boundary_family(scheme, max_ranks)
            if family == "geometry":
                r["c_ann"] = "count_if(NOT is_gap)"
                f["pos_comp_count"] = _zero("c_ann")
            else:
                r["c_cov"] = "sum(end_at - start_at + 1)"
                f["boundary_coverage"] = f"{_zero('c_cov')} / {TEXT_LENGTH}"
        raw.update(r)
        final.update(f)
    need = ["entity_id", "char_count", *(["text"] if "surface" in families else [])]
    base = entities.select(*need)
    if raw:
        nxt = spans if "next_label" in spans.columns else with_next_spans(spans, scheme)
        agg = nxt.groupBy("entity_id").agg(*[F.expr(f"{c} AS {n}") for n, c in raw.items()])
        base = base.join(agg, "entity_id", "left")
    cols = {**{n: F.expr(f"{c} AS `{n}`") for n, c in final.items()},
            **{n: c.alias(n) for n, c in surface.items()}}
    return base.select("entity_id", *[cols[n] for n in sorted(cols)])


def unpivot_features(wide: DataFrame, digits: int | None = None) -> DataFrame:
    """Wide features -> (entity_id, feature, value), zeros dropped (absent means 0.0)."""
    names = [c for c in wide.columns if c != "entity_id"]
    long = wide.unpivot(["entity_id"], names, "feature", "value")
    if digits is not None:
        long = long.withColumn("value", F.round("value", digits))
    return long.filter(F.col("value") != 0)


def transitions(spans: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """Share of each label bigram among the steps of an entity, long form (window variant)."""
    nxt = with_next_spans(spans.filter(F.col("label") != scheme.gap), scheme, whole=False)
    pairs = nxt.groupBy("entity_id", "label", "next_label").agg(F.count(F.lit(1)).alias("n"))
    # An entity has at most labels^2 rows by now; the last span counts with a NULL next label.
    steps = F.sum("n").over(Window.partitionBy("entity_id")) - 1
    known = F.col("label").isin(*scheme.labels) & F.col("next_label").isin(*scheme.labels)
    return pairs.withColumn("steps", steps).filter(known).select(
        "entity_id", F.col("label").alias("from_label"), F.col("next_label").alias("to_label"),
        "n", (F.col("n") / F.col("steps")).alias("share"))


def transitions_from_lists(spans: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """The same bigrams from arrays (documents only): a second, independent implementation."""
    labels = F.transform("spans", lambda s: s["label"])
    lists = span_lists(spans.filter(F.col("label") != scheme.gap)).select("entity_id", labels.alias("l"))
    pairs = lists.select("entity_id", (F.size("l") - 1).alias("steps"), F.explode(arrays_pairs(F.col("l"))).alias("p"))
    known = F.col("p.a").isin(*scheme.labels) & F.col("p.b").isin(*scheme.labels)
    return pairs.filter(known).groupBy(
        "entity_id", F.col("p.a").alias("from_label"), F.col("p.b").alias("to_label")
    ).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.first("steps")).alias("share"))


def transition_columns_from_lists(spans: DataFrame, entities: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """Wide transition features through the array implementation."""
    pair = F.concat(F.lit("order_trans_"), F.replace("from_label", F.lit(" "), F.lit("_")), F.lit("__"),
                    F.replace("to_label", F.lit(" "), F.lit("_")))
    names = sorted(f"order_trans_{scheme.key(a)}__{scheme.key(b)}" for a in scheme.labels for b in scheme.labels)
    wide = (
        transitions_from_lists(spans, scheme).withColumn("pair", pair)
        .groupBy("entity_id").pivot("pair", names).agg(F.first("share"))
    )
    return entities.select("entity_id").join(wide, "entity_id", "left").na.fill(0.0, names)


def rank_slots(spans: DataFrame, entities: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME,
               max_ranks: int | None = None) -> DataFrame:
    """Relative borders per rank, long form: no padding, so no bound on the number of spans."""
    ranked = with_next_spans(spans.filter(F.col("label") != scheme.gap), scheme, whole=False)
    if max_ranks is not None:
        ranked = ranked.filter(F.col("rank") <= max_ranks)
    n = F.expr(TEXT_LENGTH)
    return ranked.join(entities.select("entity_id", "char_count"), "entity_id").select(
        "entity_id", (F.col("rank") - 1).alias("rank"),
        (F.col("start_at") / n).alias("start_share"), ((F.col("end_at") + 1) / n).alias("end_share"))


def slot_rows(spans: DataFrame, entities: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME, max_ranks: int | None = None) -> DataFrame:
    """Rank slots as feature rows (entity_id, feature, value), zeros left out."""
    both = F.explode(F.array(*[
        F.struct(F.concat(F.lit(f"pos_{side}_rank_"), "rank").alias("feature"), F.col(f"{side}_share").alias("value"))
        for side in ("start", "end")]))
    rows = rank_slots(spans, entities, scheme, max_ranks).select("entity_id", both.alias("x"))
    return rows.select("entity_id", "x.*").filter("value <> 0")
