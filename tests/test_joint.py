"""Conditions with texts, fitted together, against dense solutions on a small table."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spandoc.operators import block_ridge
from spandoc.plans import conditions, joint
from spandoc.plans.evaluation import Setup
from spandoc.schemas import RHETORICAL_LABELS

GROUPS, FOLDS, ALPHAS = 3, 3, (0.5, 5.0)


def make(n=36, spans_of_last=0, seed=2):
    rng = random.Random(seed)
    vocab = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    entities, spans = [], []
    for i in range(n):
        words = rng.choices(vocab[: 4 + i % 7], k=rng.randrange(8, 30))
        text = ". ".join(" ".join(words[k:k + 5]) for k in range(0, len(words), 5))
        eid = f"e{i:02d}"
        entities.append((eid, text, len(text), float(1 + (i * 7 + len(words)) % 6), f"g{i % GROUPS}", "s", "train" if i % 4 else "test"))
        at, count = 0, rng.randrange(1, 7)
        for k in range(spans_of_last if spans_of_last and i == n - 1 else count):
            end = at + rng.randrange(1, 9)
            spans.append((eid, k + 1, at, end, rng.choice([*RHETORICAL_LABELS, "Unannotated"])))
            at = end + rng.randrange(1, 4)
    return entities, spans


@pytest.fixture(scope="module")
def setup(spark):
    return frames(spark, *make())


def frames(spark, entities, spans):
    e = spark.createDataFrame(entities, "entity_id string, text string, char_count bigint, score double, grp string, subgrp string, split string")
    s = spark.createDataFrame(spans, "entity_id string, k bigint, start_at bigint, end_at bigint, label string")
    return Setup(s.repartition(3), e.repartition(3), alpha=2.0, max_features=25, min_df=2)


def texts_of(rows, train, max_features=25, min_df=2):
    """TF-IDF rows by hand: vocabulary and idf of the training rows."""
    def counts(t):
        w = re.findall(r"\w{2,}", t.lower())
        return Counter(w + [" ".join(p) for p in zip(w, w[1:])])

    found = [counts(r[1]) for r in rows]
    df, tf = Counter(), Counter()
    for i in train:
        df.update(found[i].keys())
        tf.update(found[i])
    terms = sorted((t for t in tf if df[t] >= min_df), key=lambda t: (-tf[t], t))[:max_features]
    x = np.array([[c[t] * (math.log((1 + len(train)) / (1 + df[t])) + 1) for t in terms] for c in found])
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def scaled(x, train):
    mu, sd = x[train].mean(0), x[train].std(0)
    return (x - mu) / np.where(sd > 1e-9, sd, 1)


def dense(x, y, train, alpha):
    """Predictions of all rows by ridge with a free intercept, from the kernel of the training rows."""
    xc, yc = x - x[train].mean(0), y - y[train].mean()
    kernel = np.einsum("ij,kj->ik", xc, xc[train])
    return y[train].mean() + np.einsum("ik,k->i", kernel, np.linalg.solve(kernel[train] + alpha * np.eye(len(train)), yc[train]))


def numbers(setup, rows, name, ranks):
    wide = {r.entity_id: r for r in conditions.build_condition(name, setup.spans, setup.entities, max_ranks=ranks).collect()}
    names = conditions.feature_names(name, max_ranks=ranks)
    return names, np.array([[wide[r[0]][n] or 0.0 for n in names] for r in rows])


def ranks_of(rows, spans, train):
    n = Counter(s[0] for s in spans if s[4] != "Unannotated")
    return max(n[rows[i][0]] for i in train)


def test_alpha_by_folds_with_texts(setup):
    rows, spans = make()
    names = ["T2", "T3", "POS", "T3_PLUS_POS", "T0"]
    preds, table = joint.cross_validated(setup, names, FOLDS, ALPHAS)
    got = {(r.condition, r.entity_id): r.y_pred for r in preds.collect()}
    y, train = np.array([r[3] for r in rows]), [i for i, r in enumerate(rows) if r[6] == "train"]
    ranks, text = ranks_of(rows, spans, train), texts_of(rows, train)
    parts = np.array_split(train, FOLDS)
    for name in names:
        x = text
        if name != "T0":
            x = np.concatenate([text, scaled(numbers(setup, rows, name, ranks)[1], train)], 1)
        mse = {}
        for a in ALPHAS:
            err = []
            for held in parts:
                p = dense(x, y, [i for i in train if i not in held], a)
                err.append(((p - y)[held] ** 2).mean())
            mse[a] = np.mean(err)
            assert next(r for r in table if r[:2] == (name, a))[2] == pytest.approx(mse[a], rel=1e-5)
        best = min(ALPHAS, key=mse.get)
        assert [r[1] for r in table if r[0] == name and r[3]] == [best]
        want = dense(x, y, train, best)
        for i, r in enumerate(rows):
            if r[6] == "test":
                assert got[name, r[0]] == pytest.approx(want[i], abs=1e-5)


def test_held_out_groups_with_texts(setup):
    """Vocabulary, weights and scaling of each fold's own training rows; altered structures next to true ones."""
    rows, spans = make()
    names = ["T2", "POS_TRANS", "T3_PLUS_POS", "TS_s13", "RND_s13"]
    got = {(r.condition, r.entity_id): (r.grp, r.y_pred) for r in joint.held_out_groups(setup, names).collect()}
    assert len(got) == len(rows) * len(names)
    y = np.array([r[3] for r in rows])
    ranks = ranks_of(rows, spans, range(len(rows)))
    for name in names:
        x = numbers(setup, rows, name, ranks)[1]
        for g in range(GROUPS):
            train = [i for i, r in enumerate(rows) if r[4] != f"g{g}"]
            want = dense(np.concatenate([texts_of(rows, train), scaled(x, train)], 1), y, train, 2.0)
            for i, r in enumerate(rows):
                if r[4] == f"g{g}":
                    assert got[name, r[0]] == (r[4], pytest.approx(want[i], abs=1e-5))


def test_residualized_with_texts(setup):
    rows, spans = make()
    names = ["POS", "TRANS", "T3"]
    preds, table = joint.cross_validated(setup, names, FOLDS, (2.0,), residual=True)
    got = {(r.condition, r.entity_id): r.y_pred for r in preds.collect()}
    assert [r[0] for r in table] == [n + "_residualized" for n in names]
    y, train = np.array([r[3] for r in rows]), [i for i, r in enumerate(rows) if r[6] == "train"]
    text, ranks = texts_of(rows, train), ranks_of(rows, spans, train)
    for name in names:
        cols, x = numbers(setup, rows, name, ranks)
        c = np.stack([np.ones(len(rows)), x[:, cols.index("surface_word_count")], x[:, cols.index("count_total_components")]], 1)
        for j, col in enumerate(cols):
            if not col.startswith(("surface_", "count_", "prop_")):
                b = np.linalg.lstsq(c[train], x[train, j], rcond=None)[0]
                x[:, j] -= np.einsum("ij,j->i", c, b)
                if x[train, j].std() < 1e-9:
                    x[:, j] = 0
        want = dense(np.concatenate([text, scaled(x, train)], 1), y, train, 2.0)
        for i, r in enumerate(rows):
            if r[6] == "test":
                assert got[name + "_residualized", r[0]] == pytest.approx(want[i], abs=1e-4)


def test_an_entity_of_many_spans(spark, monkeypatch):
    """20,000 spans are 40,000 sparse columns: beyond any table, and beyond the dense block of the solver."""
    rows, spans = make(24, 20_000)
    setup = frames(spark, rows, spans)
    got = {(r.condition, r.entity_id): r.y_pred for r in joint.held_out_groups(setup, ["POS", "BOUNDARY_ONLY"]).collect()}
    y, at = np.array([r[3] for r in rows]), {r[0]: i for i, r in enumerate(rows)}
    ranks = ranks_of(rows, spans, range(len(rows)))
    assert ranks > 15_000
    slots, seen = np.zeros((len(rows), 2 * ranks)), Counter()
    for eid, _, start, end, label in sorted(spans, key=lambda s: (s[0], s[2])):
        if label != "Unannotated":
            i, k = at[eid], seen[eid]
            slots[i, 2 * k], slots[i, 2 * k + 1] = start / rows[i][2], (end + 1) / rows[i][2]
            seen[eid] += 1
    for name in ("POS", "BOUNDARY_ONLY"):
        x = np.concatenate([numbers(setup, rows, name, 0)[1], slots], 1)
        for g in range(GROUPS):
            train = [i for i, r in enumerate(rows) if r[4] != f"g{g}"]
            want = dense(np.concatenate([texts_of(rows, train), scaled(x, train)], 1), y, train, 2.0)
            for i, r in enumerate(rows):
                if r[4] == f"g{g}":
                    assert got[name, r[0]] == pytest.approx(want[i], abs=1e-3)


def test_fits_in_several_blocks_are_the_same(setup, monkeypatch):
    whole = {(r.condition, r.entity_id): r.y_pred for r in joint.held_out_groups(setup, ["T2", "T1"]).collect()}
    monkeypatch.setattr(block_ridge, "BLOCK_BYTES", 1)
    monkeypatch.setattr(block_ridge, "SLICE_BYTES", 1)
    monkeypatch.setattr(block_ridge, "BLOCK_COLUMNS", 3)
    monkeypatch.setattr(joint, "GROUPS_AT_ONCE", 2)
    parts = {(r.condition, r.entity_id): r.y_pred for r in joint.held_out_groups(setup, ["T2", "T1"]).collect()}
    assert parts.keys() == whole.keys() and all(parts[k] == pytest.approx(whole[k], abs=1e-5) for k in whole)


def test_null_texts_groups_and_scores(setup):
    ents = setup.entities.withColumn("text", F.when(F.col("entity_id") != "e05", F.col("text"))).withColumn(
        "grp", F.when(F.col("entity_id") != "e06", F.col("grp"))).withColumn("score", F.when(F.col("entity_id") != "e07", F.col("score")))
    got = joint.held_out_groups(Setup(setup.spans, ents, alpha=2.0, max_features=25, min_df=2), ["T2"]).collect()
    ids = {r.entity_id for r in got}
    assert "e05" in ids and "e06" not in ids and "e07" not in ids and len(got) == 34


def with_vectors(setup, rows):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(len(rows), 5)) * [1, 0.1, 2, 1, 1]
    vectors = setup.entities.sparkSession.createDataFrame([(r[0], v.tolist()) for r, v in zip(rows, x)], "entity_id string, embedding array<float>")
    return Setup(setup.spans, setup.entities.join(vectors, "entity_id"), alpha=2.0), x.astype(np.float32).astype(float)


def test_conditions_on_vectors(setup):
    """Vectors unscaled next to scaled structure; rows of the other splits are predicted."""
    rows, spans = make()
    vec, x = with_vectors(setup, rows)
    got = {(r.condition, r.entity_id): (r.phase, r.y_pred) for r in joint.fitted(vec, ["D0", "D_POS", "D_SHUFFLED_s13"]).collect()}
    y, train = np.array([r[3] for r in rows]), [i for i, r in enumerate(rows) if r[6] == "train"]
    for name in ("D0", "D_POS", "D_SHUFFLED_s13"):
        parts = [x] if name == "D0" else [x, scaled(numbers(setup, rows, name, ranks_of(rows, spans, train))[1], train)]
        want = dense(np.concatenate(parts, 1), y, train, 2.0)
        for i, r in enumerate(rows):
            if r[6] == "test":
                assert got[name, r[0]] == ("test", pytest.approx(want[i], abs=1e-5))
    assert len(got) == 3 * sum(r[6] == "test" for r in rows)


def test_a_run_that_dies_is_taken_up_again(setup, tmp_path, monkeypatch):
    from spandoc.plans import runs

    vec, _ = with_vectors(setup, make()[0])
    wanted = runs.cells(["D0", "D_RANDOM"], [13, 21]) + runs.cells(["NOT_A_CONDITION"], [])
    fit, fitted = runs.Runs._fit, []

    def dies(self, block, keys):
        if len(fitted) == 1:
            raise KeyboardInterrupt
        fitted.append([c.name for c in block])
        fit(self, block, keys)

    monkeypatch.setattr(runs.Runs, "_fit", dies)
    with pytest.raises(KeyboardInterrupt):
        runs.Runs(vec, str(tmp_path)).run(wanted, at_once=2)
    first = {r.condition: r.seconds for r in runs.Runs(vec, str(tmp_path)).log().collect()}
    assert set(first) == {"D0_s13", "D0_s21"}
    monkeypatch.setattr(runs.Runs, "_fit", lambda self, block, keys: fitted.append([c.name for c in block]) or fit(self, block, keys))
    again = runs.Runs(vec, str(tmp_path))
    log = {r.condition: r for r in again.run(wanted, at_once=2).collect()}
    assert fitted[1:] == [["D_RANDOM_s13", "D_RANDOM_s21"], ["NOT_A_CONDITION"], ["NOT_A_CONDITION"]]
    assert {c: r.status for c, r in log.items()} == {**dict.fromkeys(["D0_s13", "D0_s21", "D_RANDOM_s13", "D_RANDOM_s21"], "ok"), "NOT_A_CONDITION": "failed"}
    assert all(log[c].seconds == s for c, s in first.items())  # not run again
    table = again.table().collect()
    assert {(r.condition, r.phase) for r in table} == {(c, "test" if r.status == "ok" else None) for c, r in log.items()}
    # A third run only tries what failed; other settings are other cells.
    del fitted[:]
    again.run(wanted)
    assert fitted == [["NOT_A_CONDITION"], ["NOT_A_CONDITION"]]
    other = Setup(vec.spans, vec.entities, alpha=3.0)
    assert runs.key_of(wanted[0], other, "x") != runs.key_of(wanted[0], vec, "x")
    assert runs.inputs_digest(Setup(vec.spans, vec.entities.filter("entity_id > 'e03'"))) != runs.inputs_digest(vec)


def test_no_decision_is_made_without_all_cells(setup, monkeypatch):
    """A cell that failed is a row of the log, and an error where the decision is made."""
    from spandoc.catalog import modelling

    rows, _ = make()
    vec, _ = with_vectors(setup, rows)
    monkeypatch.setattr(modelling.src, "doc_entities", lambda spark, sf: setup.entities)
    monkeypatch.setattr(modelling.src, "vector_entities", lambda spark, sf: vec.entities)
    monkeypatch.setattr(modelling.src, "doc_spans", lambda spark, sf: setup.spans)
    monkeypatch.setattr(modelling, "VECTOR_CONDITIONS", ["D0", "NOT_A_CONDITION"])
    monkeypatch.setattr(modelling, "VECTOR_SEEDS", [13])
    spark = setup.entities.sparkSession
    log = {r.condition: r.status for r in modelling.run_log_vectors(spark, "").collect()}
    assert log == {"D0_s13": "ok", "NOT_A_CONDITION_s13": "failed"}
    with pytest.raises(RuntimeError, match="1 of 2 cells are not finished: NOT_A_CONDITION_s13 .failed: ValueError"):
        modelling.gate_robustness_vectors(spark, "")
    monkeypatch.setattr(modelling, "VECTOR_CONDITIONS", ["D0"])
    assert modelling.gate_robustness_vectors(spark, "").count() == 1


def test_conditions_that_no_seed_changes_are_fitted_once(setup, monkeypatch):
    rows, _ = make()
    vec, _ = with_vectors(setup, rows)
    solve, asked = joint.block_ridge.solve, []
    monkeypatch.setattr(joint.block_ridge, "solve", lambda design, fits, *a: asked.extend(f.name for f in fits) or solve(design, fits, *a))
    names = ["D0_s13", "D_POS_s13", "D_SHUFFLED_s13", "D0_s21", "D_POS_s21", "D_SHUFFLED_s21"]
    got = {(r.condition, r.entity_id): r.y_pred for r in joint.fitted(vec, names).collect()}
    assert sorted(asked) == ["D0_s13", "D_POS_s13", "D_SHUFFLED_s13", "D_SHUFFLED_s21"]
    assert len(got) == 6 * sum(r[6] == "test" for r in rows)
    for name in ("D0_s21", "D_POS_s21", "D_SHUFFLED_s21"):
        alone = {r.entity_id: r.y_pred for r in joint.fitted(vec, [name]).collect()}
        assert {e: pytest.approx(y, abs=1e-6) for (c, e), y in got.items() if c == name} == alone
