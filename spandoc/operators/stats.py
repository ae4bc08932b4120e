"""Feature audits and correlations on wide feature tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from spandoc.operators.qa import family_of, has_forbidden_prefix
from spandoc.operators.models import feature_columns
from spandoc.plans.storage import cut_lineage, forget

NEAR_CONSTANT = 1e-6


def feature_audit(wide: DataFrame, condition: str, families: dict[str, str]) -> DataFrame:
    """Per feature: population deviation, non-zero share, constancy, family, leakage flag."""
    cols = feature_columns(wide)
    agg = []
    for c in cols:
        x = f"coalesce(cast(`{c}` AS DOUBLE), 0D)"
        agg.append(F.expr(
            f"struct('{c}' AS feature_name, stddev_pop({x}) AS sd, avg(CASE WHEN {x} <> 0 THEN 1D ELSE 0D END) AS nz, "
            f"min({x}) = max({x}) AS same) AS `{c}`"))
    one = wide.agg(*agg)
    rows = one.select(F.explode(F.array(*[F.col(f"`{c}`") for c in cols])).alias("f")).select("f.*")
    name = F.col("feature_name")
    return rows.select(
        F.lit(condition).alias("condition"), name, family_of(name, families).alias("feature_family"),
        F.lit(len(cols)).cast("bigint").alias("n_dimensions_condition"), F.col("nz").alias("mean_nonzero_fraction"),
        F.col("same").alias("is_constant_train"),
        (~F.col("same") & (F.col("sd") < NEAR_CONSTANT)).alias("is_near_constant_train"),
        F.when(F.col("same"), 0.0).otherwise(F.col("sd")).alias("train_std"),
        has_forbidden_prefix(name).alias("contains_forbidden_token"))


def _t_tail(t: float, df: float) -> float:
    """Two-sided tail probability of Student's t (regularized incomplete beta, continued fraction)."""
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(x, a, b):
        tiny = 1e-300
        c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
        h = d
        for k in range(1, 400):
            even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
            d = 1.0 / (1.0 + even * d or tiny)
            c = 1.0 + even / c or tiny
            h *= d * c
            odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
            d = 1.0 / (1.0 + odd * d or tiny)
            c = 1.0 + odd / c or tiny
            step = d * c
            h *= step
            if abs(step - 1.0) < 1e-14:
                break
        return h

    if x < (a + 1.0) / (a + b + 2.0):
        return front * fraction(x, a, b) / a
    return 1.0 - front * fraction(1.0 - x, b, a) / b


def pearson_p(r: float, n: int) -> float:
    if n < 3 or math.isnan(r):
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    return _t_tail(r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)


def correlations(wide: DataFrame, structural: list[str], confounds: dict[str, str], families: dict[str, str]) -> DataFrame:
    """(feature_name, feature_family, confound, r, p) for every structural feature that varies.

    MLlib forms the whole correlation matrix; only that matrix (columns squared) reaches the driver.  Deviations
    and matrix take several passes, so the columns are stored first and ``wide`` is computed once.  ``confounds`` maps names
    to columns.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    stored = cut_lineage(wide.select(*[f"`{c}`" for c in dict.fromkeys([*structural, *confounds.values()])]))
    sds = stored.agg(*[F.expr(f"stddev_pop(`{c}`)") for c in structural], F.count(F.lit(1))).first()
    n = int(sds[-1])
    varying = [c for c, sd in zip(structural, sds) if sd is not None and sd >= 1e-12]
    cols = [*varying, *confounds.values()]
    vectors = VectorAssembler(inputCols=cols, outputCol="v").transform(stored.select(*[f"`{c}`" for c in dict.fromkeys(cols)]))
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    forget(stored)
    rows = []
    for i, c in enumerate(varying):
        for j, name in enumerate(confounds):
            r = float(matrix[i, len(varying) + j])
            rows.append((c, name, None if math.isnan(r) else r, None if math.isnan(r) else pearson_p(r, n)))
    out = wide.sparkSession.createDataFrame(rows, "feature_name string, confound string, r double, p double")
    return out.withColumn("feature_family", family_of(F.col("feature_name"), families))


def max_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Largest absolute difference between two feature tables over all entities, per column set."""
    left, right = a.alias("a"), b.alias("b")
    gap = F.greatest(F.lit(0.0), *[F.abs(F.col(f"a.`{c}`") - F.col(f"b.`{c}`")) for c in columns])
    return left.join(right, F.col("a.entity_id") == F.col("b.entity_id"), "full_outer").agg(
        F.max(gap).alias("max_abs_diff"),
        F.count_if(F.col("a.entity_id").isNull() | F.col("b.entity_id").isNull()).alias("unmatched"))
