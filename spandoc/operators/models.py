"""Regression on feature tables: scaling, ridge, cross-validation, held-out groups, trees.

Numeric conditions have at most a few hundred columns, so one pass of per-group cross
products serves every fold, alpha and feature subset.  Text conditions (sparse, tens of
thousands of columns) are fitted with MLlib.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from spandoc.schemas import RIDGE_ALPHAS


def feature_columns(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if c != "entity_id"]


# --- scaling ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Scaling:
    """Mean and population deviation per feature, fitted on training rows (constant: 1)."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def apply(self, wide: DataFrame, keep: tuple[str, ...] = ("entity_id",)) -> DataFrame:
        """Scaled columns in training order; a column the table lacks counts as 0."""
        have = set(wide.columns)
        cols = []
        for c, mu, sd in zip(self.columns, self.mean, self.scale):
            raw = f"coalesce(cast(`{c}` AS DOUBLE), 0D)" if c in have else "0D"
            cols.append(F.expr(f"({raw} - cast('{mu!r}' AS DOUBLE)) / cast('{sd!r}' AS DOUBLE) AS `{c}`"))
        return wide.select(*keep, *cols)


def fit_scaling(train: DataFrame, columns: list[str] | None = None) -> Scaling:
    cols = sorted(columns if columns is not None else feature_columns(train))
    if not cols:
        return Scaling((), (), ())
    exprs = [F.expr(f"{fn}(coalesce(cast(`{c}` AS DOUBLE), 0D))") for c in cols for fn in ("avg", "stddev_pop")]
    row = train.agg(*exprs).first()
    mean = tuple(float(x or 0.0) for x in row[0::2])
    scale = tuple(float(x) if x else 1.0 for x in row[1::2])
    return Scaling(tuple(cols), mean, scale)


# --- cross products ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Products:
    """Z'Z for Z = [1, scaled features, y], per group and in all; groups add up to any training set.

    ``groups`` (g, i, r) has one row per group and matrix row and stays in Spark; the driver holds
    the columns and one matrix, whatever the number of groups.
    """

    columns: tuple[str, ...]
    scaling: Scaling
    groups: DataFrame
    whole: object

    def total(self):
        return self.whole


def cross_products(rows: DataFrame, columns: list[str], group: str, target: str = "score") -> Products:
    """Distributed pass: every task multiplies its rows per group, Spark adds the parts."""
    import numpy as np
    import pandas as pd
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from spandoc.plans.storage import cut_lineage

    cols = sorted(columns)
    dim = len(cols) + 2
    scaling = fit_scaling(rows, cols)
    scaled = scaling.apply(rows, keep=(group, target)).select(
        F.col(group).cast("string").alias("g"), F.col(target).cast("double").alias("y"), *[f"`{c}`" for c in cols])

    def multiply(batches):
        parts: dict = {}
        for batch in batches:
            for g, part in batch.groupby("g", sort=False):
                z = np.column_stack([np.ones(len(part)), part[cols].to_numpy(dtype=float), part["y"].to_numpy(dtype=float)])
                parts[g] = parts.get(g, 0.0) + z.T @ z
        for g, m in parts.items():
            yield pd.DataFrame({"g": g, "i": range(dim), "r": list(m)})

    partial = scaled.mapInPandas(multiply, "g string, i int, r array<double>").withColumn("r", array_to_vector("r"))

    def added(parts: DataFrame, *keys: str) -> DataFrame:
        return parts.groupBy(*keys).agg(Summarizer.sum(F.col("r")).alias("r")).withColumn("r", vector_to_array("r"))

    groups = cut_lineage(added(partial, "g", "i"))
    whole = np.zeros((dim, dim))
    for r in added(groups.withColumn("r", array_to_vector("r")), "i").collect():  # one row per column
        whole[r.i] = r.r
    return Products(tuple(cols), scaling, groups, whole)


def _per_group(products: Products, fit, schema: str) -> DataFrame:
    """Rows of ``fit(group, training matrix, matrix of the group)`` for every group held out, on the executors."""
    import numpy as np
    import pandas as pd

    whole = products.groups.sparkSession.sparkContext.broadcast(products.whole)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros_like(whole.value)
        own[pdf["i"].to_numpy()] = np.stack(pdf["r"].to_numpy())
        return fit(key[0], whole.value - own, own)

    return products.groups.groupBy("g").applyInPandas(run, schema)


@dataclass(frozen=True)
class LinearFit:
    """y = intercept + sum coef * raw feature."""

    columns: tuple[str, ...]
    intercept: float
    coef: tuple[float, ...]

    def prediction(self) -> str:
        parts = [f"cast('{self.intercept!r}' AS DOUBLE)"]
        parts += [f"coalesce(cast(`{c}` AS DOUBLE), 0D) * cast('{w!r}' AS DOUBLE)" for c, w in zip(self.columns, self.coef)]
        return " + ".join(parts)


def ridge_from_products(products: Products, z, columns: list[str], alpha: float) -> LinearFit:
    """Ridge on standardized columns (population deviation of the given rows, free intercept)."""
    import numpy as np

    pos = [products.columns.index(c) for c in sorted(columns)]
    idx = np.array([p + 1 for p in pos], dtype=int)
    n = z[0, 0]
    mean = z[0, idx] / n
    y_mean = z[0, -1] / n
    cov = z[np.ix_(idx, idx)] - n * np.outer(mean, mean)
    xy = z[idx, -1] - n * mean * y_mean
    sd = np.sqrt(np.maximum(np.diag(cov) / n, 0.0))
    sd = np.where(sd > 1e-12, sd, 1.0)
    std_cov = cov / np.outer(sd, sd)
    w = np.linalg.solve(std_cov + alpha * np.eye(len(idx)), xy / sd) / sd
    # Back to raw columns: x_scaled = (x - mu) / s.
    mu = np.array([products.scaling.mean[p] for p in pos])
    s = np.array([products.scaling.scale[p] for p in pos])
    raw = w / s
    intercept = y_mean - float(w @ mean) - float(raw @ mu)
    return LinearFit(tuple(products.columns[p] for p in pos), float(intercept), tuple(float(x) for x in raw))


def _squared_error(products: Products, z, fit: LinearFit) -> float:
    """Squared error of a fit on the rows behind ``z``, from the products alone."""
    import numpy as np

    beta = np.zeros(z.shape[0])
    beta[-1] = -1.0
    beta[0] = fit.intercept
    for c, w in zip(fit.columns, fit.coef):
        p = products.columns.index(c)
        beta[p + 1] = w * products.scaling.scale[p]
        beta[0] += w * products.scaling.mean[p]
    return float(beta @ z @ beta)


def select_alpha(products: Products, columns: list[str], alphas=RIDGE_ALPHAS) -> tuple[float, list[tuple[float, float]]]:
    """Alpha with the smallest mean over folds of the held-out MSE (groups are the folds)."""
    import pandas as pd

    slim = _slim(products)

    def errors(g, z, own):
        found = [_squared_error(slim, own, ridge_from_products(slim, z, columns, a)) / float(own[0, 0]) for a in alphas]
        return pd.DataFrame({"alpha": [float(a) for a in alphas], "mse": found})

    rows = _per_group(products, errors, "alpha double, mse double").groupBy("alpha").agg(F.avg("mse").alias("mse")).collect()
    scores = [(float(a), next(r.mse for r in rows if r.alpha == float(a))) for a in alphas]
    return min(scores, key=lambda s: s[1])[0], scores


def _slim(products: Products) -> Products:
    """Without the tables, to be sent to tasks."""
    return Products(products.columns, products.scaling, None, None)


def leave_group_out_predictions(rows: DataFrame, products: Products, subsets: dict[str, list[str]], group: str,
                                alpha: float = 10.0, target: str = "score") -> DataFrame:
    """(condition, group, entity_id, y_true, y_pred): each row predicted by the fit without its group.

    One pass of products serves all conditions and folds; every fold is solved on an executor, and its
    coefficients join the rows of its group.
    """
    import pandas as pd

    slim = _slim(products)

    def fits(g, z, own):
        table = []
        for name, cols in subsets.items():
            fit = ridge_from_products(slim, z, cols, alpha)
            weight = dict(zip(fit.columns, fit.coef))
            table.append((name, g, fit.intercept, [weight.get(c, 0.0) for c in slim.columns]))
        return pd.DataFrame(table, columns=["condition", "g", "b0", "w"])

    coef = _per_group(products, fits, "condition string, g string, b0 double, w array<double>")
    x = F.expr("array(" + ", ".join(f"coalesce(cast(`{c}` AS DOUBLE), 0D)" for c in products.columns) + ") AS x")
    slim_rows = rows.select("entity_id", F.col(group).cast("string").alias("g"), F.col(target).alias("y_true"), x)
    dot = F.expr("b0 + aggregate(zip_with(x, w, (a, b) -> a * b), 0D, (s, v) -> s + v)")
    return slim_rows.join(coef, "g").select(
        "condition", F.col("g").alias("grp"), "entity_id", "y_true", dot.alias("y_pred"))


# --- MLlib fits -------------------------------------------------------------------------------


# MLlib's closed-form solver takes this many columns.
CLOSED_FORM_COLUMNS = 4096


# Columns, the first ones, that a fit of more columns keeps densely: condition vectors begin with the numeric ones.
DENSE_COLUMNS = 256


@dataclass(frozen=True)
class RidgeModel:
    """Fitted MLlib model, or the coefficients and intercept of a fit of many columns."""

    model: object
    features: str

    def transform(self, rows: DataFrame) -> DataFrame:
        if not isinstance(self.model, tuple):
            return self.model.transform(rows)
        shared = rows.sparkSession.sparkContext.broadcast(self.model)
        predict = F.udf(lambda x: float(x.dot(shared.value[0])) + shared.value[1], "double")
        return rows.withColumn("prediction", predict(self.features))


def fit_ridge(train: DataFrame, alpha: float, features: str = "features", target: str = "score", columns: int = 0,
              tolerance: float = 1e-8, iterations: int = 400) -> RidgeModel:
    """Minimize |y - b - Xw|^2 + alpha |w|^2.

    Few columns: MLlib's closed form.  MLlib divides the loss by 2n and scales the target by its
    population deviation, so regParam is alpha * sd(y) / n.  Many columns: the conjugate gradients of
    ``block_ridge`` over the stored sparse rows, every column as it is.
    """
    if 0 < columns <= CLOSED_FORM_COLUMNS:
        from pyspark.ml.regression import LinearRegression

        rows = train.select(features, F.col(target).cast("double").alias(target))
        n, spread = rows.agg(F.count(F.lit(1)), F.stddev_pop(target)).first()
        fitted = LinearRegression(
            featuresCol=features, labelCol=target, elasticNetParam=0.0, standardization=False,
            regParam=alpha * float(spread) / n, solver="normal").fit(rows)
        return RidgeModel(fitted, features)

    import numpy as np

    from spandoc.operators.block_ridge import ONE, Design, Fit, solve
    from spandoc.plans.storage import cut_lineage, forget

    spark = train.sparkSession
    vectors = cut_lineage(train.select(F.col(features).alias("x"), F.col(target).cast("double").alias("y")))
    # A stored vector is a struct; a dense one has no indices.
    rows = spark.read.schema("x struct<type:tinyint,size:int,indices:array<int>,values:array<double>>, y double").parquet(vectors.stored_at)
    if not rows.filter("y is null or isnan(y)").isEmpty():
        raise ValueError("labels must not be null or NaN")
    if not columns:
        columns = int(rows.select(F.max(F.when(F.col("x.type") == 0, F.col("x.size")).otherwise(F.size("x.values")))).first()[0])
    wide = min(columns, DENSE_COLUMNS)
    at = F.when(F.col("x.type") == 0, F.col("x.indices")).otherwise(F.sequence(F.lit(0), F.size("x.values") - 1))
    cells = F.arrays_zip(at.alias("at"), F.col("x.values").alias("value"))
    near = F.map_from_entries(F.transform(F.filter("cells", lambda c: c["at"] < wide), lambda c: F.struct(c["at"], c["value"])))
    cut = rows.withColumn("cells", cells).withColumn("near", near).withColumn("far", F.filter("cells", lambda c: c["at"] >= wide))
    core = F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda i: F.coalesce(F.element_at("near", i), F.lit(0.0)))
    stored = cut_lineage(cut.select(
        F.lit("").alias("entity_id"), "y", F.lit(0).cast("bigint").alias("fold"), F.concat(F.array(F.lit(1.0)), core).alias("core"),
        F.transform("far", lambda c: c["at"] + 1).alias("at"), F.transform("far", lambda c: c["value"]).alias("value"),
        F.array(F.lit(1.0)).alias("norms")))
    names = tuple(f"x{i}" for i in range(wide))
    design = Design(stored, (ONE, *names), 0, np.ones((columns - wide, 1)), (-1,), (), names)
    [solved] = solve(design, [Fit("ridge", names, float(alpha), text=True)], tolerance, iterations)
    for used in (vectors, stored):
        forget(used)
    return RidgeModel((solved.coef[1:, 0], float(solved.intercept[0])), features)


def numeric_vectors(wide: DataFrame, scaling: Scaling, keep: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    scaled = scaling.apply(wide, keep)
    return VectorAssembler(inputCols=list(scaling.columns), outputCol="num").transform(scaled).select(*keep, "num")


def text_vectorizer(train: DataFrame, max_features: int, min_df: int):
    """Fitted TF-IDF as MLlib stages; the vocabulary (bounded) is the same as ``fit_vocabulary``'s."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors
    import math

    from spandoc.operators.tfidf import fit_vocabulary, term_counts

    n = train.count()
    vocab = fit_vocabulary(term_counts(train), max_features, min_df).orderBy("term_id").select("term", "df").collect()
    idf = [math.log((1.0 + n) / (1.0 + r["df"])) + 1.0 for r in vocab]
    return PipelineModel([
        CountVectorizerModel.from_vocabulary([r["term"] for r in vocab], inputCol="terms", outputCol="tf"),
        ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="weighted"),
        Normalizer(p=2.0, inputCol="weighted", outputCol="text_vec"),
    ])


def with_terms(entities: DataFrame) -> DataFrame:
    from spandoc.functions.text import bigrams, terms

    w = terms(F.col("text"))
    return entities.withColumn("terms", F.concat(w, bigrams(w)))


def fit_trees(train: DataFrame, features: str = "features", target: str = "score", iterations: int = 300,
              rate: float = 0.05, depth: int = 6, seed: int = 42):
    """Boosted regression trees for the text-free conditions.

    Every tenth round is checkpointed: the errors of a round are made from those of the one before, and the plan of
    hundreds of rounds is too deep to be sent to a task.
    """
    from pyspark.ml.regression import GBTRegressor

    from spandoc.plans.storage import shared_folder

    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(train.sparkSession))
    return GBTRegressor(featuresCol=features, labelCol=target, maxIter=iterations, stepSize=rate, maxDepth=depth,
                        maxBins=255, seed=seed).fit(train)


# --- residualization --------------------------------------------------------------------------


def fit_residuals(train: DataFrame, columns: list[str], confounds: tuple[str, str]) -> dict[str, LinearFit]:
    """Least squares of each column on two confounds; all moments come from one aggregation."""
    import numpy as np

    a, b = confounds
    exprs = [f"avg(`{a}`)", f"avg(`{b}`)", f"var_pop(`{a}`)", f"var_pop(`{b}`)", f"covar_pop(`{a}`, `{b}`)"]
    for c in columns:
        exprs += [f"avg(`{c}`)", f"covar_pop(`{c}`, `{a}`)", f"covar_pop(`{c}`, `{b}`)"]
    row = [float(x or 0.0) for x in train.agg(*[F.expr(e) for e in exprs]).first()]
    ma, mb, va, vb, cab = row[:5]
    inverse = np.linalg.pinv(np.array([[va, cab], [cab, vb]]))
    fits = {}
    for i, c in enumerate(columns):
        m, ca, cb = row[5 + 3 * i: 8 + 3 * i]
        wa, wb = inverse @ np.array([ca, cb])
        fits[c] = LinearFit((a, b), float(m - wa * ma - wb * mb), (float(wa), float(wb)))
    return fits


def residualized(wide: DataFrame, fits: dict[str, LinearFit]) -> DataFrame:
    """Replace each fitted column by its residual."""
    cols = [F.expr(f"`{c}` - ({fits[c].prediction()}) AS `{c}`") if c in fits else F.col(f"`{c}`") for c in wide.columns]
    return wide.select(*cols)
