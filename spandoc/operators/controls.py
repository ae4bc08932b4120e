"""Falsification controls: shuffled labels, random boundaries, random features.

Every draw is a keyed md5 of (seed, entity, position), so controls are reproducible on any
partitioning.  Control span tables hold annotated spans only; ``k`` is the rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spandoc.functions.keyed import keyed_int, keyed_md5, keyed_normal
from spandoc.operators.geometry import overlap_pairs
from spandoc.operators.ordered import cut_hot, neighbours
from spandoc.schemas import DEFAULT_SCHEME, SPAN_ORDER, LabelScheme


def ranked_spans(spans: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """Annotated spans with their 1-based rank by start."""
    ann = spans.select("entity_id", "k", "start_at", "end_at", "label").filter(F.col("label") != scheme.gap)
    return neighbours(cut_hot(ann, "entity_id", SPAN_ORDER), SPAN_ORDER, row_number="rank").finish().drop("k")


def shuffle_labels(spans: DataFrame, seed: int, scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """Permute labels within each entity; borders stay.

    The label at rank r moves to the rank that r's key has among the keys of the entity.
    """
    ranked = ranked_spans(spans, scheme)
    keyed = ranked.select(
        "entity_id", "label", keyed_md5(F.lit(seed), F.col("entity_id"), F.col("rank")).alias("h"),
    )
    moved = neighbours(cut_hot(keyed, "entity_id", ["h"]), ["h"], row_number="rank").finish()
    return ranked.drop("label").join(moved.select("entity_id", "rank", "label"), ["entity_id", "rank"]).select(
        "entity_id", F.col("rank").alias("k"), "start_at", "end_at", "label")


def _cuts(n: Column, length: Column, seed: int) -> Column:
    """n-1 distinct sorted cut points in 1..length-1, uniform over all such sets.

    Distinct values of independent uniform draws, in order of first appearance, are a
    uniform sample.  The few entities whose draws repeat too often (long relative to their
    text) take the first n-1 of a keyed permutation of all points instead.
    """
    eid = F.col("entity_id")
    draws = F.transform(
        F.sequence(F.lit(1), (n - 1) * 4 + 64),
        lambda i: (keyed_int(F.lit(seed), eid, F.lit("cut"), i) % (length - 1) + 1).cast("bigint"))
    distinct = F.array_distinct(draws)
    everything = F.array_sort(F.transform(
        F.sequence(F.lit(1).cast("bigint"), length - 1),
        lambda x: F.struct(keyed_md5(F.lit(seed), eid, F.lit("perm"), x).alias("h"), x.alias("x"))))
    want = (n - 1).cast("int")
    return F.when(F.size(distinct) >= want, F.array_sort(F.slice(distinct, F.lit(1), want))).otherwise(
        F.array_sort(F.transform(F.slice(everything, F.lit(1), want), lambda s: s["x"])))


def random_boundaries(sizes: DataFrame, seed: int) -> DataFrame:
    """Random composition of each text into n spans: (entity_id, rank, start_at, end_at).

    ``sizes`` has entity_id, n, char_count.  The arrays are as long as the entity has spans,
    which its own text cell bounds.
    """
    n, length = F.col("n"), F.col("char_count")
    short = (n > 1) & (length < n)
    starts = (
        F.when(n == 1, F.array(F.lit(0).cast("bigint")))
        .when(short, F.transform(F.sequence(F.lit(1).cast("bigint"), n), lambda i: i - 1))
        .otherwise(F.concat(F.array(F.lit(0).cast("bigint")), _cuts(n, length, seed)))
    )
    placed = sizes.filter(n > 0).withColumn("starts", starts)
    nxt = F.transform("starts", lambda s, i: F.struct(
        s.alias("s"), F.coalesce(F.get(F.col("starts"), i + 1), F.col("char_count")).alias("nx")))
    rows = placed.select("entity_id", "char_count", "n", F.posexplode(nxt).alias("pos", "b"))
    last = F.col("char_count") - 1
    end = F.when((F.col("n") > 1) & (F.col("char_count") < F.col("n")), F.least(F.col("b.s"), last)).otherwise(
        F.col("b.nx") - 1)
    return rows.select("entity_id", (F.col("pos") + 1).cast("bigint").alias("rank"),
                       F.col("b.s").alias("start_at"), end.alias("end_at"))


def span_sizes(spans: DataFrame, entities: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    counts = spans.filter(F.col("label") != scheme.gap).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(entities.select("entity_id", "char_count"), "entity_id")


def altered_spans(control: str, spans: DataFrame, entities: DataFrame, seed: int,
                  scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """Span table of a control: shuffled labels, random borders, or both."""
    if control == "shuffled_labels":
        return shuffle_labels(spans, seed, scheme)
    if control == "random_boundaries":
        labels = shuffle_labels(spans, seed, scheme).select("entity_id", F.col("k").alias("rank"), "label")
    elif control == "random_boundaries_true_order":
        labels = ranked_spans(spans, scheme).select("entity_id", "rank", "label")
    else:
        raise ValueError(f"unknown control {control!r}")
    borders = random_boundaries(span_sizes(spans, entities, scheme), seed)
    return borders.join(labels, ["entity_id", "rank"]).select(
        "entity_id", F.col("rank").alias("k"), "start_at", "end_at", "label")


def random_features(entities: DataFrame, dims: int, seed: int) -> DataFrame:
    """``dims`` standard normals per entity, keyed by (seed, entity, dimension)."""
    eid = F.col("entity_id")
    draws = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda j: keyed_normal(F.lit(seed), eid, j))
    return entities.select("entity_id", draws.alias("v")).select(
        "entity_id", *[F.expr(f"get(v, {j}) AS rnd_{j}") for j in range(dims)])


def label_counts_equal(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Per entity: does every label occur equally often in both span tables?"""
    both = a.select("entity_id", "label", F.lit(1).alias("w")).unionByName(
        b.select("entity_id", "label", F.lit(-1).alias("w")))
    net = both.groupBy("entity_id", "label").agg(F.sum("w").alias("net"))
    return net.groupBy("entity_id").agg((F.count_if(F.col("net") != 0) == 0).alias(name))


def control_checks(spans: DataFrame, entities: DataFrame, seeds, scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """Invariants of all controls, every entity and seed, compared row by row.

    The true spans and the three control tables meet once on (entity, rank); all checks are
    aggregates of that one table.
    """
    tables = {"x": "shuffled_labels", "y": "random_boundaries", "z": "random_boundaries_true_order"}
    ranked = ranked_spans(spans, scheme)
    out = None
    for seed in seeds:
        met = ranked
        borders = None
        for s, control in tables.items():
            made = altered_spans(control, spans, entities, seed, scheme)
            borders = made if s == "y" else borders
            met = met.join(made.select(
                "entity_id", F.col("k").alias("rank"), F.col("start_at").alias(f"{s}_start"),
                F.col("end_at").alias(f"{s}_end"), F.col("label").alias(f"{s}_label")), ["entity_id", "rank"], "full_outer")

        def moved(s: str) -> Column:
            return F.count_if(~(F.col("start_at").eqNullSafe(F.col(f"{s}_start")) & F.col("end_at").eqNullSafe(F.col(f"{s}_end"))))

        def relabelled(s: str) -> Column:
            return F.count_if(~F.col("label").eqNullSafe(F.col(f"{s}_label")))

        def same_counts(s: str) -> Column:
            ok = F.lit(True)
            for t in scheme.labels:
                ok = ok & (F.count_if(F.col("label") == t) == F.count_if(F.col(f"{s}_label") == t))
            return ok

        checks = met.groupBy("entity_id").agg(
            (moved("x") == 0).alias("shuffled_boundaries_preserved"), (relabelled("x") > 0).alias("labels_changed"),
            same_counts("x").alias("shuffled_label_counts_preserved"), same_counts("y").alias("rb_label_counts_preserved"),
            (moved("y") > 0).alias("rb_boundaries_differ"),
            (F.count("start_at") == F.count("y_start")).alias("rb_component_count_preserved"),
            (relabelled("z") == 0).alias("rseq_label_order_preserved"), (moved("z") > 0).alias("rseq_boundaries_differ"),
            (F.count("start_at") == F.count("z_start")).alias("rseq_component_count_preserved"),
        )
        apart = overlap_pairs(borders, scheme).select("entity_id", (F.col("overlap_pairs") == 0).alias("rb_non_overlapping"))
        one = checks.join(apart, "entity_id", "left").withColumn("seed", F.lit(seed).cast("bigint"))
        out = one if out is None else out.unionByName(one)
    return out


def shuffle_checks(true_features: DataFrame, shuffled_features: DataFrame) -> DataFrame:
    """Per entity: are the count features equal and did any order feature change?"""
    counts = [c for c in true_features.columns if c.startswith(("count_", "prop_"))]
    order = [c for c in true_features.columns if c.startswith("order_")]
    a, b = true_features.alias("a"), shuffled_features.alias("b")

    def same(cols) -> Column:
        cond = F.lit(True)
        for c in cols:
            cond = cond & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        return cond

    return a.join(b, F.col("a.entity_id") == F.col("b.entity_id")).select(
        F.col("a.entity_id").alias("entity_id"),
        same(counts).alias("preserved_count_features_ok"), (~same(order)).alias("order_features_changed"))
