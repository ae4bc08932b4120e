"""Model fits against dense numpy solutions, and table IO."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spandoc.operators import models
from spandoc.plans import conditions
from spandoc.sources import tables


def dense_ridge(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return w, y.mean() - x.mean(0) @ w


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6)) * [1, 10, 0.1, 5, 1, 0] + [0, 100, 0, 3, 1, 2]
    y = x @ [0.5, 0.02, 1, 0.1, -0.3, 0] + rng.normal(size=300)
    cols = [f"f{i}" for i in range(6)]
    rows = [(str(i), f"g{i % 5}", float(y[i]), *map(float, x[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "entity_id string, grp string, score double, " + ", ".join(f"{c} double" for c in cols))
    return df.cache(), x, y, cols


def test_group_products_leave_one_group_out(data):
    df, x, y, cols = data
    products = models.cross_products(df, cols, "grp")
    preds = {r.entity_id: r.y_pred for r in models.leave_group_out_predictions(df, products, {"all": cols}, "grp").collect()}
    for g in range(5):
        held = np.arange(300) % 5 == g
        mu, sd = x[~held].mean(0), x[~held].std(0)
        sd[sd < 1e-12] = 1
        w, b = dense_ridge((x[~held] - mu) / sd, y[~held], 10.0)
        want = (x[held] - mu) / sd @ w + b
        got = np.array([preds[str(i)] for i in np.flatnonzero(held)])
        assert np.abs(got - want).max() < 1e-8


def test_alpha_selection_scores(data):
    df, x, y, cols = data
    best, scores = models.select_alpha(models.cross_products(df, cols[:5], "grp"), cols[:5], (1.0, 1000.0))
    assert best == 1.0 and scores[0][1] < scores[1][1]
    err = []
    for g in range(5):
        held = np.arange(300) % 5 == g
        mu, sd = x[~held][:, :5].mean(0), x[~held][:, :5].std(0)
        w, b = dense_ridge((x[~held][:, :5] - mu) / sd, y[~held], 1.0)
        err.append((((x[held][:, :5] - mu) / sd @ w + b - y[held]) ** 2).mean())
    assert scores[0][1] == pytest.approx(np.mean(err), rel=1e-8)


@pytest.mark.parametrize("columns", [6, 0])
def test_ridge_fits_match_dense_solution(spark, data, columns):
    """Closed form, and (columns=0 -> iterative path is forced below) penalty rows."""
    df, x, y, cols = data
    scaling = models.fit_scaling(df, cols)
    rows = models.numeric_vectors(df, scaling, ("entity_id", "score"))
    if columns == 0:
        old, models.CLOSED_FORM_COLUMNS = models.CLOSED_FORM_COLUMNS, 0
    try:
        fit = models.fit_ridge(rows, 10.0, features="num", columns=6, tolerance=1e-10)
    finally:
        if columns == 0:
            models.CLOSED_FORM_COLUMNS = old
    sd = x.std(0)
    sd[sd < 1e-12] = 1
    z = (x - x.mean(0)) / sd
    w, b = dense_ridge(z, y, 10.0)
    got = {r.entity_id: r.prediction for r in fit.transform(rows).collect()}
    assert max(abs(got[str(i)] - (z[i] @ w + b)) for i in range(300)) < 1e-4


def test_residuals_are_uncorrelated_with_confounds(data):
    df, _, _, _ = data
    fits = models.fit_residuals(df, ["f2", "f3"], ("f0", "f1"))
    res = models.residualized(df, fits)
    row = res.agg(F.corr("f2", "f0"), F.corr("f3", "f1"), F.avg("f3")).first()
    assert all(abs(v) < 1e-9 for v in row)


def test_scaling_keeps_constant_columns(data):
    df, _, _, cols = data
    s = models.fit_scaling(df, cols)
    assert s.scale[5] == 1.0
    wide = s.apply(df.drop("f0"))
    assert wide.columns == ["entity_id", *cols]


def test_condition_names_and_sizes():
    size = {c: len(conditions.feature_names(c, max_ranks=26)) for c in ("T1", "T2", "T3", "POS", "T3_PLUS_POS", "RND", "BOUNDARY_ONLY")}
    assert size == {"T1": 5, "T2": 24, "T3": 115, "POS": 86, "T3_PLUS_POS": 177, "RND": 115, "BOUNDARY_ONLY": 86}
    assert conditions.resolve("TS_s13").seed == 13
    with pytest.raises(ValueError):
        conditions.resolve("NOPE")


def test_csv_round_trip_and_missing_file(spark, tmp_path):
    from spandoc.schemas import ANNOTATION_SCHEMA

    names = ANNOTATION_SCHEMA.fieldNames()
    row = {n: None for n in names}
    row.update(essay_id="5.26244E+12", full_text='two\nlines, "quoted"', discourse_start="0.0", discourse_end="4",
               discourse_type="Lead", discourse_type_num="Lead 1", discourse_text="two\nl")
    import csv

    path = tmp_path / "a.csv"
    with open(path, "w", newline="") as f:
        w = csv.DictWriter(f, names)
        w.writeheader()
        w.writerow(row)
    got = tables.read_annotations(spark, [str(path)]).first()
    assert got.essay_id == "5.26244E+12" and got.full_text == 'two\nlines, "quoted"' and got._source_file == "a.csv"
    span = tables.spans_of(tables.read_annotations(spark, [str(path)])).first()
    assert (span.start_at, span.end_at, span.label) == (0, 4, "Lead")
    with pytest.raises(Exception):
        tables.read_annotations(spark, [str(tmp_path / "none.csv")]).count()
    tables.save(spark.createDataFrame([("a", "train")], "entity_id string, split string"), str(tmp_path / "t"))
    assert tables.load(spark, str(tmp_path / "t")).count() == 1


def test_fit_of_many_columns_reaches_the_optimum(spark, data, monkeypatch):
    """Sparse and dense rows, columns held densely and others, at the tolerance that queries use."""
    from pyspark.ml.linalg import Vectors

    _, x, y, _ = data
    monkeypatch.setattr(models, "CLOSED_FORM_COLUMNS", 0)
    monkeypatch.setattr(models, "DENSE_COLUMNS", 2, raising=False)
    z = x / np.where(x.std(0) < 1e-12, 1, x.std(0))
    vector = [Vectors.dense(r) if i % 2 else Vectors.sparse(len(r), [(j, v) for j, v in enumerate(r) if v]) for i, r in enumerate(z.tolist())]
    rows = spark.createDataFrame([(str(i), v, float(t)) for i, (v, t) in enumerate(zip(vector, y))], ["entity_id", "num", "score"])
    got = models.fit_ridge(rows, 10.0, features="num", columns=z.shape[1]).transform(rows).select("entity_id", "prediction").collect()
    w, b = dense_ridge(z, y, 10.0)
    assert [r.prediction for r in sorted(got, key=lambda r: int(r.entity_id))] == pytest.approx(z @ w + b, abs=1e-6)
