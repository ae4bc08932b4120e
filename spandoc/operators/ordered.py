"""Ordered operators (neighbour, rank, prefix sum) that survive a hot entity.

A window partitioned by entity puts all rows of that entity in one task.  That is right
for ordinary entities and fatal for one that holds a third of the table.  Here entities
above ``spandoc.hotKeyRows`` rows are cut into consecutive chunks along their whole order, by
exact counts; windows then run per (entity, chunk) and a table with one row per chunk
carries the first row, the row count and the sums across chunk borders.  The threshold
decides how the work is dealt, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

HOT_ROWS_CONF = "spandoc.hotKeyRows"
HOT_ROWS_DEFAULT = "2000000"
_CHUNK = "__chunk"
# Digits by which a crowded range of keys is cut in one round: at most 16**3 parts.
_DIGITS = 3


@dataclass(frozen=True)
class Ordered:
    """A table together with its chunking (``hot`` is False when no entity needed one)."""

    df: DataFrame
    entity: str
    hot: bool

    def map(self, fn) -> "Ordered":
        return replace(self, df=fn(self.df))

    def finish(self) -> DataFrame:
        return self.df.drop(_CHUNK) if self.hot else self.df


def hot_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, HOT_ROWS_DEFAULT))


def order_key(df: DataFrame, order_by: Sequence[str]) -> Column:
    """A string that sorts like the columns ``order_by`` do (ascending, nulls first).

    Integers and times become sixteen hex digits with the sign flipped, strings the hex
    digits of their bytes and a closing mark below every digit.  Fractions keep nine
    decimals; rows that only differ beyond stay together, so later columns are left out.
    """
    parts = []
    for name in order_by:
        kind, col = df.schema[name].dataType, F.col(name)
        if isinstance(kind, T.StringType):
            parts.append(F.coalesce(F.concat(F.hex(col.cast("binary")), F.lit(".")), F.lit("!")))
            continue
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            held = F.least(F.greatest(col.cast("double"), F.lit(-1e9)), F.lit(1e9))
            number = F.when(F.isnan(col.cast("double")), F.lit(2**62)).otherwise(F.floor(held * 1e9))
        elif isinstance(kind, T.DateType):
            number = F.unix_date(col)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            number = F.unix_micros(col.cast("timestamp"))
        else:
            number = col
        digits = F.lpad(F.hex(number.cast("bigint").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
        parts.append(F.coalesce(F.concat(F.lit("1"), digits), F.lit("0")))
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            break
    return F.concat(*parts)


def cut_hot(df: DataFrame, entity: str, order_by: Sequence[str]) -> Ordered:
    """Find hot entities and number their chunks along ``order_by``.

    One narrow pass with map-side aggregation decides; without a hot entity the plan of
    the caller stays a single window.  Keys of a hot entity are counted by prefix.  A prefix with
    too many rows is followed to where its smallest and largest key part, and cut
    there, until every part is small enough (rows of one whole key stay together).  Shared
    prefixes and outliers therefore cost a round at most, and nulls are keys like others.
    """
    limit = hot_rows(df)
    hot = df.groupBy(entity).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).select(entity)
    if hot.isEmpty():
        return Ordered(df, entity, False)
    rows = df.withColumns({"__key": order_key(df, order_by), "__part": F.lit("")})
    parts = _part_sizes(rows.join(hot, entity, "left_semi"), entity)
    while True:
        wide = parts.filter((F.col("__c") > limit) & (F.col("__lo") < F.col("__hi")))
        if wide.isEmpty():
            break
        cuts = wide.select(entity, "__part", (_common("__lo", "__hi") + _DIGITS).alias("__len"))
        rows = rows.join(cuts, [entity, "__part"], "left").withColumn(
            "__part", F.coalesce(F.substring(F.col("__key"), F.lit(1), F.col("__len")), F.col("__part"))).drop("__len")
        parts = _part_sizes(rows.join(hot, entity, "left_semi"), entity)
    upto = Window.partitionBy(entity).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    chunks = parts.select(entity, "__part", (F.floor(F.coalesce(F.sum("__c").over(upto), F.lit(0)) / F.lit(limit)) + 1).alias(_CHUNK))
    out = rows.join(chunks, [entity, "__part"], "left").withColumn(_CHUNK, F.coalesce(F.col(_CHUNK), F.lit(0)))
    return Ordered(out.drop("__key", "__part"), entity, True)


def _part_sizes(rows: DataFrame, entity: str) -> DataFrame:
    return rows.groupBy(entity, "__part").agg(
        F.count(F.lit(1)).alias("__c"), F.min("__key").alias("__lo"), F.max("__key").alias("__hi"))


def _common(a: str, b: str) -> Column:
    """Length of the common prefix of two different strings."""
    same = F.aggregate(
        F.sequence(F.lit(1), F.length(a)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, i: F.struct(
            F.when(s["on"] & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(s["n"]).alias("n"),
            (s["on"] & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))).alias("on")))
    return same["n"]


def neighbours(
    table: Ordered,
    order_by,
    *,
    within=(),
    lead: dict[str, str] | None = None,
    row_number: str | None = None,
    running: dict[str, str] | None = None,
) -> Ordered:
    """Add ordered columns per entity (and per value of the ``within`` columns).

    ``lead`` maps new columns to the column read from the next row, ``row_number`` names
    a 1-based rank, ``running`` maps new columns to the column whose earlier rows are
    summed.  ``order_by`` begins with the columns given to ``cut_hot``, or with some of the first of them.
    """
    lead, running = lead or {}, running or {}
    keys = [table.entity, *within]
    part = keys + ([_CHUNK] if table.hot else [])
    by_order = Window.partitionBy(*part).orderBy(*order_by)
    before = by_order.rowsBetween(Window.unboundedPreceding, -1)
    new: dict[str, Column] = {}
    for name, src in lead.items():
        new[name] = F.lead(src).over(by_order)
    if row_number:
        new[row_number] = F.row_number().over(by_order).cast("bigint")
    for name, src in running.items():
        new[name] = F.coalesce(F.sum(src).over(before), F.lit(0)).cast("bigint")
    if not table.hot:
        return table.map(lambda d: d.withColumns(new))

    out = table.df.withColumns({**new, "__last": F.lead(F.lit(True)).over(by_order).isNull()})
    firsts = F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)],
                            *[F.col(c).alias(f"v_{n}") for n, c in lead.items()]))
    edges = (
        table.df.filter(F.col(_CHUNK) > 0)
        .groupBy(*part)
        .agg(firsts.alias("__f"), F.count(F.lit(1)).alias("__n"),
             *[F.sum(src).alias(f"__s_{n}") for n, src in running.items()])
    )
    across = Window.partitionBy(*keys).orderBy(_CHUNK)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        *part,
        F.lead("__f").over(across).alias("__nf"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__bn"),
        *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in running],
    )
    out = out.join(edges, part, "left")
    fixed: dict[str, Column] = {}
    for name in lead:
        fixed[name] = F.when(F.col("__last"), F.col("__nf")[f"v_{name}"]).otherwise(F.col(name))
    if row_number:
        fixed[row_number] = F.col(row_number) + F.coalesce(F.col("__bn"), F.lit(0))
    for name in running:
        fixed[name] = F.col(name) + F.coalesce(F.col(f"__b_{name}"), F.lit(0))
    helper = ["__last", "__nf", "__bn", *[f"__b_{n}" for n in running]]
    return replace(table, df=out.withColumns(fixed).drop(*helper))
