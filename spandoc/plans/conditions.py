"""Feature conditions: named recipes of families, label source and boundaries."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from spandoc.operators import controls, structure
from spandoc.operators.geometry import with_next_spans
from spandoc.plans.storage import cut_lineage
from spandoc.schemas import DEFAULT_SCHEME, LabelScheme

BASE = ("surface", "count")
ORDER = ("firstlast", "transition", "label_position")
# Fixed value: number of random features, the size of the order families of the default scheme.
RANDOM_DIMS = 91


@dataclass(frozen=True)
class Condition:
    """``control`` names the altered structure that the order families are computed on."""

    families: tuple[str, ...]
    text: bool = True
    control: str | None = None
    model: str = "ridge"
    seed: int | None = None
    embedding: bool = False


REGISTRY: dict[str, Condition] = {
    "T0": Condition(()),
    "T1": Condition(("surface",)),
    "T2": Condition(BASE),
    "T3": Condition(BASE + ORDER),
    "N0": Condition(("surface",), text=False, model="trees"),
    "N1": Condition(BASE, text=False, model="trees"),
    "N2": Condition(BASE + ORDER, text=False, model="trees"),
    "NS": Condition(BASE + ORDER, text=False, model="trees", control="shuffled_labels"),
    "FIRSTLAST": Condition(BASE + ("firstlast",)),
    "TRANS": Condition(BASE + ("transition",)),
    "LABELPOS": Condition(BASE + ("label_position",)),
    "NO_TRANS": Condition(BASE + ("firstlast", "label_position")),
    "NO_POS": Condition(BASE + ("firstlast", "transition")),
    "POS": Condition(BASE + ("geometry",)),
    "BOUNDARY_ONLY": Condition(BASE + ("boundary_only",)),
    "POS_TRANS": Condition(BASE + ("geometry", "transition")),
    "T3_PLUS_POS": Condition(BASE + ORDER + ("geometry",)),
    "COUNTS_TRANS": Condition(BASE + ("transition_from_lists",)),
    "TS": Condition(BASE + ORDER, control="shuffled_labels"),
    "RB": Condition(BASE + ORDER, control="random_boundaries"),
    "REAL_BOUNDARY_SHUFFLED_LABEL": Condition(BASE + ORDER, control="shuffled_labels"),
    "RANDOM_BOUNDARY_TRUE_SEQUENCE": Condition(BASE + ORDER, control="random_boundaries_true_order"),
    "RND": Condition(BASE + ("random",)),
    "D0": Condition((), text=False, embedding=True),
    "D2": Condition(BASE, text=False, embedding=True),
    "D_POS": Condition(BASE + ("geometry",), text=False, embedding=True),
    "D_STRUCT": Condition(BASE + ORDER + ("geometry",), text=False, embedding=True),
    "D_SHUFFLED": Condition(BASE + ORDER, text=False, embedding=True, control="shuffled_labels"),
    "D_RANDOM": Condition(BASE + ("random",), text=False, embedding=True),
}


@dataclass(frozen=True)
class Shared:
    """A stored feature table that several conditions read, and the columns that each family built in it."""

    table: DataFrame
    columns: dict[str, list[str]]


def resolve(name: str) -> Condition:
    """Condition by name; ``TS_s13`` is condition TS with seed 13."""
    if name in REGISTRY:
        return REGISTRY[name]
    m = re.fullmatch(r"(.+)_s(\d+)", name)
    if not m or m.group(1) not in REGISTRY:
        raise ValueError(f"unknown condition {name!r}")
    return replace(REGISTRY[m.group(1)], seed=int(m.group(2)))


def true_families(name: str) -> list[str]:
    """Families that a condition computes on the true structure."""
    cond = resolve(name)
    return [f for f in cond.families if f in structure.FAMILIES and not (cond.control and f in ORDER)]


def build_shared(names: list[str], spans: DataFrame, entities: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME, max_ranks: int = 0) -> Shared:
    """The true structure of all conditions ``names``, computed once: texts are read and spans meet their neighbours once."""
    families = list(dict.fromkeys(f for n in names for f in true_families(n)))
    ordered = with_next_spans(spans, scheme)
    built = {f: [c for c in structure.structure_features(ordered, entities, (f,), scheme, max_ranks).columns if c != "entity_id"] for f in families}
    return Shared(cut_lineage(structure.structure_features(ordered, entities, tuple(families), scheme, max_ranks)), built)


def build_condition(
    name: str,
    spans: DataFrame,
    entities: DataFrame,
    scheme: LabelScheme = DEFAULT_SCHEME,
    max_ranks: int | None = None,
    seed: int = 42,
    random_dims: int = RANDOM_DIMS,
    shared: Shared | None = None,
) -> DataFrame:
    """Feature table of a condition: one row per entity, feature columns sorted by name.

    Surface, count and geometry families always see the true structure; only order
    families are recomputed on the altered one.  The true families are read from ``shared`` if it is given.
    """
    cond = resolve(name)
    seed = seed if cond.seed is None else cond.seed
    wanted = set(cond.families)
    if max_ranks is None and wanted & {"geometry", "boundary_only"}:
        max_ranks = structure.max_rank_count(spans, entities.filter("split = 'train'"), scheme)
    altered = tuple(f for f in cond.families if f in ORDER) if cond.control else ()
    true = tuple(true_families(name))
    if shared is None:
        parts = [structure.structure_features(spans, entities, true, scheme, max_ranks or 0)]
    else:
        parts = [shared.table.select("entity_id", *sorted({c for f in true for c in shared.columns[f]}))]
    if altered:
        fake = controls.altered_spans(cond.control, spans, entities, seed, scheme)
        parts.append(structure.structure_features(fake, entities, altered, scheme))
    if "transition_from_lists" in wanted:
        parts.append(structure.transition_columns_from_lists(spans, entities, scheme))
    if "random" in wanted:
        parts.append(controls.random_features(entities, random_dims, seed))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p.hint("merge"), "entity_id")  # a stored table is no broadcast, however small its file
    return out.select("entity_id", *sorted(c for c in out.columns if c != "entity_id"))


def condition_rows(name: str, spans: DataFrame, entities: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME, seed: int = 42) -> DataFrame:
    """Features of a condition as rows (entity_id, feature, value), zeros left out.

    Rank slots are rows from the start, up to the most spans of a training entity, so entities of any length have them.
    """
    rows = structure.unpivot_features(build_condition(name, spans, entities, scheme, 0, seed))
    if not {"geometry", "boundary_only"} & set(resolve(name).families):
        return rows
    ranks = structure.max_rank_count(spans, entities.filter("split = 'train'"), scheme)
    return rows.unionByName(structure.slot_rows(spans, entities, scheme, ranks))


# Family under which the names of a condition's family are listed, where the two differ.
LISTED_AS = {"geometry": "position", "boundary_only": "position", "transition_from_lists": "transition"}


def names_by_family(scheme: LabelScheme = DEFAULT_SCHEME, max_ranks: int = 0, random_dims: int = RANDOM_DIMS) -> dict[str, list[str]]:
    """Feature names of every family, derived from the scheme without touching data."""
    keys = [scheme.key(t) for t in scheme.labels]
    boundary = [f"pos_{s}_rank_{i}" for s in ("start", "end") for i in range(max_ranks)]
    boundary += [f"pos_len_{p}" for p in ("mean", "std", "min", "max")]
    boundary += ["pos_gap_count", "pos_gap_len_mean", "pos_gap_len_std", "pos_gap_len_max", "pos_gap_pos_mean"]
    pairs = [f"order_trans_{a}__{b}" for a in keys for b in keys]
    return {
        "surface": [f"surface_{p}" for p in ("word_count", "char_count", "sentence_count", "paragraph_count", "mean_word_length")],
        "count": ["count_total_components", "count_total_segments", "count_annotation_coverage",
                  "count_unannotated_gaps", "count_unannotated_proportion",
                  *[f"count_{k}" for k in keys], *[f"prop_{k}" for k in keys]],
        "firstlast": [f"order_{e}_is_{k}" for e in ("first", "final") for k in keys],
        "transition": pairs,
        "transition_from_lists": pairs,
        "label_position": [f"order_{p}_pos_{k}" for p in ("mean", "first", "final", "std") for k in keys],
        "geometry": [*boundary, "pos_comp_count"],
        "boundary_only": [*boundary, "boundary_coverage"],
        "random": [f"rnd_{i}" for i in range(random_dims)],
    }


def feature_names(name: str, scheme: LabelScheme = DEFAULT_SCHEME, max_ranks: int = 0,
                  random_dims: int = RANDOM_DIMS) -> list[str]:
    """Names a condition must have."""
    names = names_by_family(scheme, max_ranks, random_dims)
    return sorted(n for f in resolve(name).families for n in names[f])


def feature_families(scheme: LabelScheme = DEFAULT_SCHEME, max_ranks: int = 0, random_dims: int = RANDOM_DIMS) -> dict[str, str]:
    """Feature name -> family it is listed under."""
    return {n: LISTED_AS.get(f, f) for f, names in names_by_family(scheme, max_ranks, random_dims).items() for n in names}


def manifest_rows(spark, names: list[str], scheme: LabelScheme = DEFAULT_SCHEME, max_ranks: int = 0) -> DataFrame:
    """(condition, feature_name) of many conditions."""
    rows = [(c, f) for c in names for f in feature_names(c, scheme, max_ranks)]
    return spark.createDataFrame(rows, "condition string, feature_name string")


def actual_manifest(name: str, wide: DataFrame) -> DataFrame:
    """(condition, feature_name, n_nonzero) of a built feature table: its columns, and the entities where they are not 0."""
    cols = [c for c in wide.columns if c != "entity_id"]
    counts = wide.agg(*[F.expr(f"count_if(`{c}` <> 0) AS `{c}`") for c in cols])
    return counts.unpivot([], cols, "feature_name", "n_nonzero").select(F.lit(name).alias("condition"), "feature_name", "n_nonzero")
