"""Small scalar expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spandoc.schemas import SCORE_MAX, SCORE_MIN


def clip(y: Column, lo: int = SCORE_MIN, hi: int = SCORE_MAX) -> Column:
    return F.least(F.greatest(y, F.lit(float(lo))), F.lit(float(hi)))


def clip_and_round(y: Column, lo: int = SCORE_MIN, hi: int = SCORE_MAX) -> Column:
    """Clip to [lo, hi], then round half to even."""
    return F.rint(clip(y, lo, hi)).cast("bigint")


def relative_position(start: Column, end: Column, length: Column) -> Column:
    """``0.12–0.34``: span borders as shares of the text length, two decimals."""
    return F.when(length == 0, F.lit("0.00–0.00")).otherwise(
        F.concat(
            F.format_string("%.2f", start.cast("double") / length),
            F.lit("–"),
            F.format_string("%.2f", (end + 1).cast("double") / length),
        )
    )


def joined_set(col: Column) -> Column:
    """Sorted distinct values joined by ``|`` (for columns with a bounded domain)."""
    return F.array_join(F.array_sort(F.collect_set(col.cast("string"))), "|")
