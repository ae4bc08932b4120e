"""How filters interact: what each one removes after every possible set of the others."""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from spandoc.llm.common import Space, heavy_join

MOST_FILTERS = 6
BLANKS = r"[\x20\x09-\x0D]+"


TEXT_FILTERS = "ABCDE"


def text_failures(entities: DataFrame, group: str = "grp") -> DataFrame:
    """entity_id, ``group`` and one boolean per filter of TEXT_FILTERS, true where the row fails it.

    ``entities`` has ``entity_id``, ``text`` and ``group``; other columns are ignored, null texts are empty texts.
    A: under 50 words.  B: under 65 % of the words distinct.  C: over 5 % of the characters in A-Z.
    D: any of # $ % & * |.  E: the same text as a row of a smaller entity_id, anywhere in the table (a null
    id is smaller than none, and none is smaller than it).

    Texts are read once and meet as sha256 digests, those of frequent texts by broadcast.
    """
    space = Space(entities.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    rows = space.write(entities.select(
        "entity_id", F.col(group).alias("grp"), F.sha2(text, 256).alias("digest"),
        (F.size(words) < 50).alias("A"),
        (100 * F.size(F.array_distinct(words)).cast("bigint") < 65 * F.size(words).cast("bigint")).alias("B"),
        (100 * capitals.cast("bigint") > 5 * F.length(text).cast("bigint")).alias("C"),
        text.rlike("[#$%&*|]").alias("D")))
    first = space.write(rows.groupBy("digest").agg(F.min("entity_id").alias("first"), F.count(F.lit(1)).alias("rows"))
                        .filter("rows > 1"))
    repeated = F.coalesce(F.col("entity_id") > F.col("first"), F.lit(False))
    return heavy_join(rows, first, "digest", "rows", "left").select(
        "entity_id", F.col("grp").alias(group), "A", "B", "C", "D", repeated.alias("E"))


def filter_interactions(entities: DataFrame, filters: dict[str, Column], losses: dict[str, Column],
                        group: str = "grp") -> DataFrame:
    """Counts of every step of every order in which the filters can be applied, per value of ``group``.

    ``filters`` names boolean columns over ``entities`` that are true where a row fails, ``losses``
    columns that are true where losing it matters (null counts as false); other columns are ignored.
    A null group is the empty string.  Every row counts, repeated rows, null ids and null texts too; an
    empty table has no groups and gives no rows.  At most MOST_FILTERS filters, because there is a row per order.

    Returns, zeros included, group, filter_order (the names joined), step (int, from 1) and bigint counts:
    kept after the step, removed by it, redundant (failing its filter, removed earlier), unique_fails
    (failing no other filter), ``<loss>_lost`` for each loss among the removed, and shapley (what its filter
    removes, summed over all orders at any step).

    One table of failing rows is stored per filter.  Rows in none of them stay whatever is done; the
    others go level by level through the sets of filters that can come before a step.  Which
    order a set was applied in does not matter, so each set occurs once: its survivors are those of a smaller set
    left after an anti join with one more failing table, and a semi join and an anti join of a
    failing table with them are the removed and the redundant rows of the next filter.
    """
    names = list(filters)
    if not 0 < len(names) <= MOST_FILTERS or any(not n for n in names):
        raise ValueError(f"between 1 and {MOST_FILTERS} named filters")
    n = len(names)
    space = Space(entities.sparkSession)
    bit = {name: 1 << i for i, name in enumerate(names)}
    lost = [f"lost_{i}" for i in range(len(losses))]

    def flag(c: Column) -> Column:
        return F.coalesce(c.cast("boolean"), F.lit(False))

    # The row number is stored, so it stays the same in all that is read from this table.
    rows = space.write(entities.select(
        F.coalesce(F.col(group).cast("string"), F.lit("")).alias("part"),
        *[flag(c).alias(f"fails_{i}") for i, c in enumerate(filters.values())],
        *[flag(c).cast("bigint").alias(name) for name, c in zip(lost, losses.values())],
        F.monotonically_increasing_id().alias("row")))
    failing = {name: space.write(rows.filter(f"fails_{i}").select("row", "part", *lost)) for i, name in enumerate(names)}
    anything = reduce(DataFrame.unionByName, [t.select("row") for t in failing.values()])
    parts = space.write(rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows")))
    clean = rows.join(anything, "row", "left_anti").groupBy("part").agg(F.count(F.lit(1)).alias("clean"))
    level = space.write(rows.join(anything, "row", "left_semi").select(F.lit(0).alias("done"), "row", "part"))

    survivors, steps = [], []
    for size in range(n + 1):
        # Sets of this many filters, for each filter that can come next.
        survivors.append(space.write(level.groupBy("done", "part").agg(F.count(F.lit(1)).alias("kept"))))
        if size == n:
            break
        sets = [s for s in range(1 << n) if s.bit_count() == size]
        after = reduce(DataFrame.unionByName, [
            failing[name].withColumn("filter", F.lit(name)).withColumn(
                "done", F.explode(F.array(*[F.lit(s) for s in sets if not s & bit[name]]))) for name in names])
        here = level.select("done", "row")
        for kind, how in (("removed", "left_semi"), ("redundant", "left_anti")):
            steps.append(space.write(after.join(here, ["row", "done"], how).groupBy("part", "done", "filter").agg(
                F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in lost])))
        # A set is reached by its last filter alone.
        following = reduce(DataFrame.unionByName, [
            level.filter(F.col("done") < bit[name]).join(failing[name].select("row"), "row", "left_anti")
            .withColumn("done", F.col("done").bitwiseOR(F.lit(bit[name]))) for name in names])
        level = space.write(following)

    # Every group with every set and next filter, zeros included.
    cells = [(s, name) for s in range(1 << n) for name in names if not s & bit[name]]
    grid = parts.select("part", F.explode(F.array(*[F.struct(F.lit(s).alias("done"), F.lit(name).alias("filter")) for s, name in cells])).alias("c"))
    grid = grid.select("part", "c.done", "c.filter")
    found = reduce(DataFrame.unionByName, steps).groupBy("part", "done", "filter").agg(
        *[F.sum(F.when(F.col("kind") == kind, F.col("n"))).alias(kind) for kind in ("removed", "redundant")],
        *[F.sum(F.when(F.col("kind") == "removed", F.col(c))).alias(c) for c in lost])
    stay = reduce(DataFrame.unionByName, survivors).select("part", F.col("done").alias("then"), "kept")
    own = reduce(lambda c, name: c.when(F.col("filter") == name, bit[name]), names[1:], F.when(F.col("filter") == names[0], bit[names[0]]))
    counts = (
        grid.join(found, ["part", "done", "filter"], "left").withColumn("then", F.col("done").bitwiseOR(own))
        .join(stay, ["part", "then"], "left").join(clean, "part", "left").fillna(0, ["removed", "redundant", "kept", "clean", *lost])
        .withColumn("kept", F.col("kept") + F.col("clean")))
    counts = space.write(counts)
    # A filter comes after a given set in as many orders as the set and the rest can be arranged.
    orders = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("done") + 1)
    others = (1 << n) - 1 - own
    of_filter = counts.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("done") == others, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * orders).alias("shapley"))

    def before(order: tuple[str, ...], step: int) -> int:
        return sum(bit[f] for f in order[:step])

    values = ", ".join(
        f"({place}, {k + 1}, {before(order, k)}, {names.index(f)})"
        for place, order in enumerate(permutations(names)) for k, f in enumerate(order))
    plan = entities.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(place, step, done, f)")
    name_of = F.element_at(F.array(*map(F.lit, names)), F.col("f") + 1)
    order_of = F.element_at(F.array(*[F.lit("".join(o)) for o in permutations(names)]), F.col("place") + 1)
    plan = plan.select(order_of.alias("filter_order"), "step", "done", name_of.alias("filter"))
    # The plan is a constant table of n * n! rows.
    out = counts.join(of_filter, ["part", "filter"]).join(F.broadcast(plan), ["done", "filter"])
    return out.select(
        F.col("part").alias(group), "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
        *[F.col(c).alias(f"{name}_lost") for c, name in zip(lost, losses)], "shapley")
