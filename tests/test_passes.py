"""Inputs that several steps share are computed once, with the results of separate computations."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spandoc.operators import block_ridge, bootstrap, stats
from spandoc.plans import conditions, evaluation, joint
from spandoc.plans.evaluation import Setup
from spandoc.plans.storage import cut_lineage
from spandoc.schemas import RHETORICAL_LABELS


def counted(df):
    """``df`` and a counter of the rows that were computed of it."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema), seen


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    entities, spans = [], []
    for i in range(40):
        text = " ".join(rng.choices(["alpha", "beta.", "gamma!", "delta"], k=rng.randrange(5, 30)))
        entities.append((f"e{i:02d}", text, len(text), float(1 + i % 6), f"g{i % 3}", "s", "train" if i % 5 else "test", [float(i % 7), float(i % 3)] if i % 2 else None))
        at = 0
        for k in range(rng.randrange(1, 7)):
            end = at + rng.randrange(1, 9)
            spans.append((f"e{i:02d}", k + 1, at, end, rng.choice([*RHETORICAL_LABELS, "Unannotated"])))
            at = end + rng.randrange(1, 4)
    e = spark.createDataFrame(entities, "entity_id string, text string, char_count bigint, score double, grp string, subgrp string, split string, embedding array<double>")
    s = spark.createDataFrame(spans, "entity_id string, k bigint, start_at bigint, end_at bigint, label string")
    return e, s, len(spans)


def test_correlations_compute_their_table_once(spark):
    rows = [(f"e{i}", float(i % 5), float(i * i % 11), 2.0, float(i % 7)) for i in range(60)]
    wide, seen = counted(spark.createDataFrame(rows, "entity_id string, a double, b double, c double, w double").repartition(3))
    found = {(r.feature_name, r.confound): r.r for r in stats.correlations(wide, ["a", "b", "c"], {"words": "w"}, {}).collect()}
    assert seen.value == len(rows)
    x = np.array([r[1:] for r in rows])
    assert set(found) == {("a", "words"), ("b", "words")}
    for i, n in enumerate("ab"):
        assert found[n, "words"] == pytest.approx(np.corrcoef(x[:, i], x[:, 3])[0, 1])


def test_bootstrap_reads_its_predictions_once(spark):
    rows = [(c, f"e{i}", float(1 + i % 6), 1 + (i * m) % 6 + 0.2) for c, m in (("A", 3), ("B", 5)) for i in range(50)]
    plain = spark.createDataFrame(rows, "condition string, entity_id string, y_true double, y_pred double")
    preds, seen = counted(plain)
    got = bootstrap.bootstrap_differences(preds, "A", ["B"], 5, [1, 2], "keyed").collect()
    assert len(got) == 10 and seen.value == len(rows)


def test_conditions_share_one_structure(spark, tables):
    ents, spans, n = tables
    names = ["T1", "T3", "NO_TRANS", "COUNTS_TRANS", "TS_s13", "RND_s13"]
    read, seen = counted(spans)
    shared = conditions.build_shared(names, read, ents)
    assert seen.value <= 2 * n  # hot entities are looked for once, then the features are made
    for name in names:
        own = conditions.build_condition(name, spans, ents)
        got = conditions.build_condition(name, spans, ents, shared=shared)
        assert got.columns == own.columns
        assert sorted(got.collect()) == sorted(own.collect())


def test_scaling_and_vectors_compute_features_once(tables):
    ents, spans, n = tables
    read, seen = counted(spans)
    evaluation.condition_vectors("N1", Setup(read, ents))[0].collect()
    assert seen.value <= 2 * n


def test_shared_structure_leaves_vectors_as_they_are(tables):
    ents, spans, n = tables
    read, seen = counted(spans)
    setup, names = Setup(read, ents), ["N1", "N2"]
    setup.share(names)
    for name in names:
        got = {r.entity_id: r.features.toArray() for r in evaluation.condition_vectors(name, setup)[0].collect()}
        own = {r.entity_id: r.features.toArray() for r in evaluation.condition_vectors(name, Setup(spans, ents))[0].collect()}
        assert got.keys() == own.keys() and all(np.allclose(got[e], own[e], rtol=0, atol=1e-12) for e in own)
    assert seen.value <= 2 * n


def test_a_joint_job_computes_its_spans_once(tables):
    ents, spans, n = tables
    read, seen = counted(spans)
    preds = joint.fitted(Setup(read, ents), ["D_STRUCT_s1", "D_SHUFFLED_s1", "D_SHUFFLED_s2"])
    assert {r.entity_id for r in preds.collect()} == {f"e{i:02d}" for i in range(5, 40, 10)}
    assert seen.value == n


def test_products_multiply_a_row_once(monkeypatch):
    rng = np.random.default_rng(3)
    n, k, folds = 200, 5, rng.integers(-1, 4, 200)
    core = np.column_stack([np.ones(n), rng.normal(size=(n, k - 1))])
    y = rng.normal(size=n)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(y), pa.array(folds), pa.array(list(core)), pa.array([[]] * n, pa.list_(pa.int32())),
         pa.array([[]] * n, pa.list_(pa.float64())), pa.array([[1.0, 1.0]] * n)], names=["y", "fold", "core", "at", "value", "norms"])
    design = block_ridge.Design(None, tuple("abcde"), 0, np.zeros((0, 2)), (-1, -1))
    multiplied = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            got = np.asarray(self)[key]
            multiplied.append(len(got))
            return got

    head = block_ridge.Slice.head
    monkeypatch.setattr(block_ridge.Slice, "head", lambda self, width: head(self, width).view(Watched))

    def summed(rows, work, height, width, first_text):
        out = np.zeros((height, width))
        work(block_ridge.Slice(batch, first_text), out)
        return out

    monkeypatch.setattr(block_ridge, "_summed", summed)
    pairs = [(v, h) for v in (0, 1) for h in (-1, 0, 2, 9)]
    found = block_ridge._moments(design, pairs)
    for v, h in pairs:
        x = core[(folds >= 0) & (folds != h)]
        x = x - x.mean(0)
        assert np.allclose(found[v, h].gram, x.T @ x, atol=1e-9)
    assert sum(multiplied) == (folds >= 0).sum()


@pytest.mark.parametrize("name", ["N2", "NS_s13", "D2"])
def test_entity_tables_are_never_broadcast(tables, name):
    """A stored feature table has a small file and many rows."""
    ents, spans, _ = tables
    if name == "D2":
        ents = ents.filter("embedding is not null")
    ents, spans = cut_lineage(ents), cut_lineage(spans)
    setup = Setup(spans, ents)
    setup.share([name])
    vectors, _ = evaluation.condition_vectors(name, setup)
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert vectors.count() == ents.count()


def test_trees_get_all_their_rounds(spark, tables, monkeypatch):
    """No condition of ``gbt_numeric`` is cut short; conditions fitted together predict what each predicts alone."""
    from spandoc.catalog import modelling

    ents, spans, _ = tables
    fit, asked = evaluation.models.fit_trees, []

    def short(train, iterations=300, **kw):
        asked.append(iterations)
        return fit(train, iterations=2, **kw)

    monkeypatch.setattr(evaluation.models, "fit_trees", short)
    monkeypatch.setattr(modelling.src, "doc_entities", lambda spark, sf: ents)
    monkeypatch.setattr(modelling.src, "doc_spans", lambda spark, sf: spans)
    rows = modelling.gbt_numeric(spark, "").collect()
    assert asked == [300] * 4 and {(r.condition, r.phase) for r in rows} == {(c, p) for c in ("N0", "N1", "N2", "NS_s13") for p in ("train", "test")}
    together = evaluation.run_together(["N0", "NS_s13"], Setup(spans, ents))
    for name in ("N0", "NS_s13"):
        alone = {(r.entity_id, r.y_pred) for r in evaluation.run_condition(name, Setup(spans, ents)).collect()}
        assert {(r.entity_id, r.y_pred) for r in together.filter(F.col("condition") == name).collect()} == alone


def test_rounds_of_trees_are_checkpointed(spark):
    """Without a folder for checkpoints the plan of a round would hold those of all rounds before it."""
    from pyspark.ml.linalg import Vectors

    from spandoc.operators import models

    rows = [(Vectors.dense([float(i % 7), float(i % 5)]), float(i % 7 + i % 3)) for i in range(60)]
    train = cut_lineage(spark.createDataFrame(rows, ["features", "score"]).coalesce(1))
    model = models.fit_trees(train, iterations=12, depth=2)
    assert model.getNumTrees == 12 and spark.sparkContext.getCheckpointDir() is not None
