"""Shared pieces of the corpus operators: ASCII case, intermediate tables, joins on skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spandoc.plans.storage import forget, shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A key whose rows exceed this share of all rows is joined through a broadcast; at most HEAVY keys can.
HEAVY = 10_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else untouched."""
    return F.translate(text, UPPER, LOWER)


def hex_digits(value: Column) -> Column:
    """A 64-bit integer as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def sized(ids: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A stored table of ids, marked for broadcast if it has no more than ``rows`` of them."""
    return F.broadcast(ids) if ids.count() <= rows else ids


class Space:
    """Intermediate tables below the folder that ``spark.checkpoint.dir`` names.

    The folder is shared by the driver and all executors, so a lost executor takes nothing with it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = shared_folder(spark)
        self.tables = 0

    def write(self, df: DataFrame) -> DataFrame:
        """The rows of ``df``, computed once and read back from the shared folder."""
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stored_at = path
        return out

    def write_swept(self, df: DataFrame) -> DataFrame:
        """The same, and the shuffle files of the step go with its end."""
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            return self.write(df)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later step reads."""
        forget(df)


def heavy_join(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, how: str = "inner") -> DataFrame:
    """Equi-join (``inner`` or ``left``) of ``left`` with the unique keys of ``right``, safe for skewed keys.

    ``weight`` is a column of ``right`` with the number of left rows of the key.  Keys that hold more
    than 1/HEAVY of all of them are at most HEAVY many: these are broadcast, and what is left has no
    hot key.  ``left`` is read twice, so it should be a stored table.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HEAVY > total
    first, rest = right.filter(hot).drop(weight), right.filter(~hot).drop(weight)
    keys = F.broadcast(first.select(key))
    return left.join(F.broadcast(first), key).unionByName(left.join(keys, key, "left_anti").join(rest, key, how))
