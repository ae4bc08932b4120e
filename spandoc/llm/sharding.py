"""Shards of bounded size: extendible hashing over hash-prefix bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spandoc.llm.common import Space

HASH_BITS = 60
ROUND_BITS = 12


def _prefix(bits: int) -> Column:
    """The first ``bits`` of the hash as a number."""
    return F.shiftright("hash", HASH_BITS - bits)


def extendible_shards(entities: DataFrame, limit_bytes: int = 1 << 20) -> DataFrame:
    """Deal entities into shards of at most ``limit_bytes`` of UTF-8 text.

    ``entities`` has ``entity_id`` and ``text``; other columns are ignored.  A shard is a prefix of the id's 60-bit
    hash (of md5 of the id as text); the empty prefix holds everything, and only a shard that is too
    large and has more than one row splits, on one more bit.  Returns one row per input row: entity_id,
    shard (the prefix as 0s and 1s), n_bytes, shard_bytes, shard_rows, fits.  ``fits`` is false where no bit can
    help: a single text above the limit, or rows of one id (null is an id too) that together exceed it.
    Null and empty texts have no bytes.

    Sizes are summed per hash cell before anything is shuffled.  The directory grows in rounds of
    12 bits: a round has at most 4096 cells for each shard of the round before that is still too
    large, and only the rows of those are looked at again.
    """
    space = Space(entities.sparkSession)
    name = F.coalesce(F.col("entity_id").cast("string"), F.lit(""))
    rows = space.write(entities.select(
        "entity_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("bigint").alias("hash")))
    left, placed, level = rows, None, 0
    while True:
        top = min(HASH_BITS, level + ROUND_BITS)
        cells = left.groupBy(_prefix(top).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        cells = space.write(cells)
        # The sums of every prefix of a cell; the shortest one that is small enough is its shard.
        steps = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(level + (level > 0)), F.lit(top))).alias("depth"))
        at = F.expr(f"shiftright(cell, {top} - depth)")
        sums = steps.groupBy("depth", at.alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        done = (F.col("bytes") <= limit_bytes) | (F.col("n") == 1) | (F.col("depth") == HASH_BITS)
        small = sums.filter(done)
        found = steps.select("cell", "depth", at.alias("prefix")).join(small, ["depth", "prefix"])
        shards = space.write(found.groupBy("cell").agg(F.min_by(F.struct("depth", "prefix", "bytes", "n"), "depth").alias("shard")))
        keyed = left.withColumn("cell", _prefix(top))
        here = keyed.join(shards, "cell").select("entity_id", "n_bytes", "shard.*")
        placed = here if placed is None else placed.unionByName(here)
        open_cells = cells.join(shards, "cell", "left_anti").select("cell")
        if open_cells.isEmpty():
            break
        left = space.write(keyed.join(open_cells, "cell", "left_semi").select(*rows.columns))
        level = top
    bits = F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0"))
    return placed.select(
        "entity_id", F.when(F.col("depth") == 0, "").otherwise(bits).alias("shard"), "n_bytes",
        F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_rows"), (F.col("bytes") <= limit_bytes).alias("fits"))
