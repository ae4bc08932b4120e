"""Chunked order: the same result below and above the threshold, whatever the positions look like."""

import pytest
from pyspark.sql import functions as F

from spandoc.operators.metrics import kappa, score_cells
from spandoc.operators.ordered import cut_hot, neighbours
from spandoc.operators.splits import contiguous_folds


def placed(spark, rows, kind="bigint"):
    df = spark.createDataFrame(rows, f"entity_id string, at {kind}, k bigint, n bigint").repartition(4)
    cut = cut_hot(df, "entity_id", ["at", "k"])
    out = neighbours(cut, ["at", "k"], lead={"next_k": "k"}, row_number="rank", running={"sum": "n"}).finish()
    return sorted((r.entity_id, r.rank, r.k, r.next_k, r["sum"]) for r in out.collect())


def expected(rows):
    out = []
    for e in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == e), key=lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[2]))
        total = 0
        for i, (_, _, k, n) in enumerate(mine):
            out.append((e, i + 1, k, mine[i + 1][2] if i + 1 < len(mine) else None, total))
            total += n
    return sorted(out)


CASES = {
    "nulls": [("a", None if i in (3, 7) else i, i, 1) for i in range(10)],
    "only nulls": [("a", None, i, i) for i in range(10)],
    "outlier": [("a", i, i, 2) for i in range(200)] + [("a", 10**9, 200, 1), ("a", -10**12, 201, 1)],
    "ties": [("a", 5, i, 1) for i in range(40)] + [("b", 5, 1, 1)],
    "two hot": [(e, (i * 7919) % 101 - 50, i, i) for e in "ab" for i in range(60)] + [("c", 1, 1, 1)],
}


@pytest.mark.parametrize("case", CASES)
def test_chunks_change_nothing(spark, hot, case):
    assert placed(spark, CASES[case]) == expected(CASES[case])


def test_chunks_are_small(spark, hot):
    for rows, kind in ((CASES["outlier"], "bigint"), ([("a", f"customer-{i:08d}", 0, 1) for i in range(300)], "string"),
                       ([("a", float(i) / 7, 0, 1) for i in range(100)], "double")):
        cut = cut_hot(spark.createDataFrame(rows, f"entity_id string, at {kind}, k bigint, n bigint"), "entity_id", ["at", "k"])
        assert cut.df.groupBy("__chunk").count().agg(F.max("count")).first()[0] <= 6


def test_strings_that_begin_alike(spark, hot):
    rows = [("a", s, i, 1) for i, s in enumerate(["", "a", "a.", "ab", "aé", "b", "a\x00", "中", "a" * 30, "a" * 31])]
    df = spark.createDataFrame(rows, "entity_id string, at string, k bigint, n bigint")
    out = neighbours(cut_hot(df, "entity_id", ["at"]), ["at"], row_number="rank").finish()
    got = [r["at"] for r in out.orderBy("rank").collect()]
    assert got == sorted((r[1] for r in rows), key=str.encode)


def test_folds_of_ids_with_a_common_prefix(spark, hot):
    ids = [f"customer-{i:08d}" for i in range(53)]
    got = {r.entity_id: r.fold for r in contiguous_folds(spark.createDataFrame([(i,) for i in ids], "entity_id string"), 5).collect()}
    assert [got[i] for i in ids] == [1] * 11 + [2] * 11 + [3] * 11 + [4] * 10 + [5] * 10


def test_kappa_of_large_labels(spark):
    rows = [("c", 0.0, 64.0), ("c", 64.0, 0.0), ("c", 10.0, 74.0), ("c", 74.0, 10.0), ("c", 5.0, 5.0)]
    df = spark.createDataFrame(rows, "condition string, y_true double, y_pred double")
    cells = score_cells(df, ["condition"], 0, 100)
    place = {v: i for i, v in enumerate(sorted({x for r in rows for x in r[1:]}))}
    for labels, of in (("present", place.get), ("value", lambda v: v)):
        t, p = [of(r[1]) for r in rows], [of(r[2]) for r in rows]
        n = len(rows)
        seen = sum((a - b) ** 2 for a, b in zip(t, p)) / n
        chance = sum((a - b) ** 2 for a in t for b in p) / n / n
        assert kappa(cells, ["condition"], labels).first().qwk == pytest.approx(1 - seen / chance)
