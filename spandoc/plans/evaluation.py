"""Running conditions: features -> fit -> long prediction table -> metrics and run log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from spandoc.operators import models, splits, structure
from spandoc.operators.tfidf import MAX_FEATURES, MIN_DF
from spandoc.plans import conditions
from spandoc.plans.storage import cut_lineage
from spandoc.schemas import DEFAULT_SCHEME, RIDGE_ALPHAS, LabelScheme

PREDICTION_SCHEMA = ("condition string, base string, seed bigint, phase string, entity_id string, grp string, subgrp string, "
                     "y_true double, y_pred double")
# Results of the numeric part of a text condition carry this ending.
NUMERIC = "_numeric"


@dataclass
class Setup:
    """Shared inputs of a run; ``entities`` needs a split column with train and other rows."""

    spans: DataFrame
    entities: DataFrame
    scheme: LabelScheme = DEFAULT_SCHEME
    alpha: float = 10.0
    max_features: int = MAX_FEATURES
    min_df: int = MIN_DF
    tree_iterations: int = 300
    max_ranks: int | None = None
    vectorizer: object = None
    shared: conditions.Shared | None = None

    def share(self, names: list[str]) -> None:
        """Computes the true structure that the conditions ``names`` have once, for all of them."""
        ranks = self.ranks() if any(_needs_ranks(conditions.resolve(n)) for n in names) else 0
        self.shared = conditions.build_shared(names, self.spans, self.entities, self.scheme, ranks)

    def ranks(self) -> int:
        if self.max_ranks is None:
            self.max_ranks = structure.max_rank_count(self.spans, self.entities.filter("split = 'train'"), self.scheme)
        return self.max_ranks

    def text_stages(self):
        """TF-IDF fitted once on the training texts and shared by all conditions."""
        if self.vectorizer is None:
            self.vectorizer = models.text_vectorizer(self.entities.filter("split = 'train'"), self.max_features, self.min_df)
        return self.vectorizer


def condition_vectors(name: str, setup: Setup) -> tuple[DataFrame, int]:
    """(entity_id, split, score, grp, subgrp, features) of a condition and its vector size.

    Tables of a row per entity merge at any size: stored features are much smaller in their files than in a broadcast.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    cond = conditions.resolve(name)
    ents = setup.entities
    keep = [c for c in ("entity_id", "split", "score", "grp", "subgrp") if c in ents.columns]
    parts, size = [], 0
    rows = ents.select(*keep)
    if cond.families:
        # Stored, as scaling and vectors both read it.
        wide = cut_lineage(conditions.build_condition(
            name, setup.spans, ents, setup.scheme, setup.ranks() if _needs_ranks(cond) else 0, shared=setup.shared))
        train = wide.join(ents.filter("split = 'train'").select("entity_id"), "entity_id", "left_semi")
        scaling = models.fit_scaling(train)
        rows = rows.join(models.numeric_vectors(wide, scaling).hint("merge"), "entity_id")
        parts.append("num")
        size += len(scaling.columns)
    if cond.text:
        stages = setup.text_stages()
        texts = stages.transform(models.with_terms(ents.select("entity_id", "text"))).select("entity_id", "text_vec")
        rows = rows.join(texts.hint("merge"), "entity_id")
        parts.append("text_vec")
        size += len(stages.stages[0].vocabulary)
    if cond.embedding:
        vec = ents.select("entity_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("emb"))
        rows = rows.join(vec.hint("merge"), "entity_id")
        parts.append("emb")
        size += int(ents.select(F.max(F.size("embedding"))).first()[0])
    return VectorAssembler(inputCols=parts, outputCol="features").transform(rows).select(*keep, "features"), size


def _needs_ranks(cond) -> bool:
    return bool({"geometry", "boundary_only"} & set(cond.families))


def run_condition(name: str, setup: Setup) -> DataFrame:
    """Fit on train rows, predict every row: one long prediction table with a phase column."""
    cond = conditions.resolve(name)
    vectors, size = condition_vectors(name, setup)
    vectors = cut_lineage(vectors)
    train = vectors.filter("split = 'train'")
    if cond.model == "trees":
        model = models.fit_trees(train, iterations=setup.tree_iterations)
    else:
        model = models.fit_ridge(train, setup.alpha, columns=size)
    base = name.rsplit("_s", 1)[0] if cond.seed is not None else name
    have = set(vectors.columns)
    scored = model.transform(vectors)
    return scored.select(
        F.lit(name).alias("condition"), F.lit(base).alias("base"), F.lit(cond.seed).cast("bigint").alias("seed"),
        F.col("split").alias("phase"), "entity_id",
        *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("grp", "subgrp")],
        F.col("score").cast("double").alias("y_true"), F.col("prediction").alias("y_pred"))


def run_together(names: list[str], setup: Setup) -> DataFrame:
    """Predictions of many conditions that share the true structure, fitted at the same time.

    Boosted trees are hundreds of small jobs one after another, so the fits of several conditions wait side by side.
    """
    from concurrent.futures import ThreadPoolExecutor
    from functools import reduce

    from pyspark import inheritable_thread_target

    setup.share(names)
    with ThreadPoolExecutor(len(names)) as pool:
        run = inheritable_thread_target(setup.entities.sparkSession)(lambda name: run_condition(name, setup))
        preds = list(pool.map(run, names))
    return reduce(lambda a, b: a.unionByName(b), preds)


def run_conditions(names: list[str], setup: Setup) -> tuple[DataFrame, DataFrame]:
    """Predictions of many conditions and a run log; a failing condition becomes a log row.

    The predictions of a condition are stored before it counts as done, so failures while they
    are computed are recorded too.
    """
    import time

    spark = setup.entities.sparkSession
    preds = spark.createDataFrame([], PREDICTION_SCHEMA)
    log = []
    for name in names:
        started = time.time()
        try:
            preds = preds.unionByName(cut_lineage(run_condition(name, setup)))
            log.append((name, conditions.resolve(name).seed, "ok", None, time.time() - started))
        except Exception as e:  # recorded, the other conditions still run
            seed = None
            log.append((name, seed, "failed", f"{type(e).__name__}: {e}"[:500], time.time() - started))
    schema = "condition string, seed bigint, status string, error string, seconds double"
    return preds, spark.createDataFrame(log, schema)


def choose_alpha(setup: Setup, condition: str = "T2", folds: int = 5, alphas=RIDGE_ALPHAS):
    """k-fold choice of alpha on the training rows, from the numeric features of a condition only: (alpha, [(alpha, mse)])."""
    train = setup.entities.filter("split = 'train'")
    cond = conditions.resolve(condition)
    wide = conditions.build_condition(condition, setup.spans, train, setup.scheme, setup.ranks() if _needs_ranks(cond) else 0)
    rows = wide.join(train.select("entity_id", "score"), "entity_id").join(splits.contiguous_folds(train, folds), "entity_id")
    cols = models.feature_columns(wide)
    products = models.cross_products(rows, cols, "fold")
    return models.select_alpha(products, cols, alphas)


def leave_one_group_out(setup: Setup, names: list[str], group: str = "grp", widest: str = "T3_PLUS_POS") -> DataFrame:
    """Held-out-group predictions from the numeric features of conditions that are column subsets of ``widest``.

    Texts take no part, so the results are named ``<condition>_numeric``; ``leave_one_group_out_refit``
    fits texts as well.
    """
    wide = conditions.build_condition(widest, setup.spans, setup.entities, setup.scheme, setup.ranks())
    rows = cut_lineage(wide.join(setup.entities.select("entity_id", "score", group), "entity_id"))
    cols = models.feature_columns(wide)
    subsets = {n + NUMERIC: conditions.feature_names(n, setup.scheme, setup.ranks()) for n in names}
    missing = {n: sorted(set(s) - set(cols)) for n, s in subsets.items() if set(s) - set(cols)}
    if missing:
        raise ValueError(f"conditions are not part of {widest}: {missing}")
    products = models.cross_products(rows, cols, group)
    return models.leave_group_out_predictions(rows, products, subsets, group, setup.alpha)


def leave_one_group_out_refit(setup: Setup, names: list[str], group: str = "grp") -> DataFrame:
    """Held-out-group predictions by refitting everything, text vocabulary included, per fold."""
    groups = [r[0] for r in setup.entities.select(group).distinct().orderBy(group).collect()]
    out = None
    for held in groups:
        role = F.when(F.col(group) == held, "held").otherwise("train")
        fold = Setup(setup.spans, setup.entities.withColumn("split", role), setup.scheme, setup.alpha,
                     setup.max_features, setup.min_df, setup.tree_iterations, setup.ranks() if any(
                         _needs_ranks(conditions.resolve(n)) for n in names) else 0)
        for name in names:
            one = run_condition(name, fold).filter("phase = 'held'").withColumn("held_out", F.lit(held))
            out = one if out is None else out.unionByName(one)
    return out


def fold_table(preds: DataFrame, names: list[str], baseline: str = "T2") -> DataFrame:
    """Per held-out group and condition: metrics, difference to the baseline, best condition."""
    from spandoc.operators import metrics as m

    scored = m.metrics(preds, ["condition", "grp"])
    base = scored.filter(F.col("condition") == baseline).select("grp", F.col("qwk").alias("base_qwk"))
    best = m.best_condition(scored, "grp", names)
    return scored.join(base, "grp", "left").join(best, "grp", "left").withColumn(
        "qwk_minus_baseline", F.col("qwk") - F.col("base_qwk")).drop("base_qwk", "best_qwk").withColumnRenamed(
        "n", "n_test").withColumnRenamed("grp", "held_out")
