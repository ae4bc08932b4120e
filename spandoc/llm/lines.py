"""Repeated lines: levelled sorted runs of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spandoc.llm.common import Space, ascii_lower, heavy_join

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """What two lines must share to be the same line: blanks stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class LineRuns:
    """A levelled store of sorted runs; a run has one row per line hash with its entities so far.

    ``add`` merges a new batch against the stored runs: lines that already have ``settle``
    entities and a keeper at least as large as the batch's bring nothing new and are anti-joined away,
    all others form a new sorted run at level 0.  ``fanout`` runs of one level are compacted
    into one run of the next.
    """

    def __init__(self, space: Space, settle: int, fanout: int = 2):
        self.space, self.settle, self.fanout = space, settle, fanout
        self.levels: list[list[DataFrame]] = []

    def _store(self, run: DataFrame) -> DataFrame:
        return self.space.write(run.sortWithinPartitions("line"))

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for r in runs[1:]:
            rows = rows.unionByName(r)
        return rows.groupBy("line").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))

    def merged(self) -> DataFrame | None:
        """One row per line hash: entities counted (at least ``settle``, if so many) and the largest of them."""
        runs = [r for level in self.levels for r in level]
        return self._merge(runs) if runs else None

    def add(self, batch: DataFrame) -> None:
        """``batch`` has distinct (line, entity_id) rows; an entity is in one batch only."""
        run = batch.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max("entity_id").alias("keeper"))
        known = self.merged()
        if known is not None:
            settled = known.filter(F.col("n") >= self.settle).select("line", F.col("keeper").alias("kept"))
            run = run.alias("r").join(
                settled.alias("s"),
                F.expr("r.line = s.line AND (r.keeper <= s.kept OR r.keeper IS NULL)"), "left_anti")
        self._place(self._store(run), 0)

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._place(self._store(self._merge(old)), level + 1)
            for r in old:
                self.space.drop(r)


def drop_repeated_lines(
    entities: DataFrame, min_chars: int = 40, min_entities: int = 5, batches: int = 4, fanout: int = 2,
) -> DataFrame:
    """Drop lines that many entities share, except in the largest ``entity_id`` that holds them.

    ``entities`` has ``entity_id`` (any orderable type) and ``text``; other columns pass through.
    Lines of a text end at newlines.  Keys (``line_key``) of ``min_chars`` code points or more
    found in ``min_entities`` entities or more lose all their lines but those of the largest entity.

    Returns the input columns with the remaining lines as ``text``, and ``n_lines`` (before
    dropping) and ``n_dropped``; input columns of these two names are replaced.  A null text
    counts as one empty line and becomes an empty text.  Rows that share an id count as one
    entity, each row keeps its own text.  A null id counts as one entity, the smallest.
    """
    space = Space(entities.sparkSession)
    rest = [c for c in entities.columns if c not in ("entity_id", "text", "n_lines", "n_dropped")]
    docs = entities.select(
        "entity_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(*rest, F.lit(0).alias("_")).alias("others"),
    ).withColumn("digest", F.xxhash64("text"))
    lines = docs.select("entity_id", "digest", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    key = line_key(F.col("line"))
    hashed = space.write(
        lines.withColumn("key", key).filter(F.length("key") >= min_chars)
        .select("entity_id", "digest", "k", F.unhex(F.md5("key")).alias("line"),
                F.pmod(F.xxhash64("entity_id"), F.lit(batches)).cast("int").alias("batch"))
    )
    runs = LineRuns(space, min_entities, fanout)
    for b in range(batches):
        runs.add(hashed.filter(F.col("batch") == b).select("line", "entity_id").distinct())
    merged = runs.merged()
    repeated = space.write(merged.filter(F.col("n") >= min_entities).select("line", "keeper"))
    uses = hashed.groupBy("line").agg(F.count(F.lit(1)).alias("uses")).join(repeated, "line")
    dropped = (
        heavy_join(hashed, space.write(uses), "line", "uses")
        .filter(~F.col("entity_id").eqNullSafe(F.col("keeper")))
        .groupBy("entity_id", "digest").agg(F.collect_set("k").alias("dropped"))
    )
    d = dropped.select(F.col("entity_id").alias("e"), F.col("digest").alias("g"), "dropped")
    joined = docs.join(d, docs.entity_id.eqNullSafe(d.e) & (docs.digest == d.g), "left")
    split = joined.withColumn("lines", F.split("text", "\n"))
    n = F.size("lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("dropped"))
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n"))
    out = split.select(
        "entity_id", text.alias("text"), "others", n.cast("bigint").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
    names = [c for c in entities.columns if c not in ("n_lines", "n_dropped")]
    return out.select(
        *[F.col(c) if c in ("entity_id", "text") else F.col("others").getField(c).alias(c) for c in names],
        "n_lines", "n_dropped",
    )
