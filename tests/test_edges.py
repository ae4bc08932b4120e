"""Hand-made edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from spandoc.functions import text as tx
from spandoc.functions.scalar import clip_and_round, relative_position
from spandoc.plans import conditions
from spandoc.operators import audit, bootstrap, controls, geometry, metrics as m, qa, sequences, splits, stats, structure, tfidf
from spandoc.schemas import DEFAULT_SCHEME, LabelScheme

SMALL = LabelScheme(labels=("L1", "L2"), gap="gap", lead="L1", position="L1", claim="L2", closing="L2")


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize("text,start,end,quoted,status", [
    ("abcdef", 0, 2, "abc", "exact_inclusive"),
    ("abcdef", 0, 3, "abc", "exact_exclusive"),
    ("abcdef", 0, 6, "abc", "outside_boundary"),
    ("abcdef", -1, 2, "abc", "invalid_span"),
    ("abcdef", 3, 2, "abc", "invalid_span"),
    ("ab cd, ef", 0, 5, "cd", "discourse_text_trimmed"),
    ("ab cd ef", 2, 5, "cd", "strip_match_inclusive"),
    ("ab cd ef", 3, 5, " cd", "strip_match_inclusive"),
    ("abcdef", 0, 2, "xyz", "mismatch"),
    ("abcdef", 0, 2, None, "mismatch"),
])
def test_span_match_status(spark, text, start, end, quoted, status):
    df = spark.createDataFrame([(text, start, end, quoted)], "t string, s bigint, e bigint, q string")
    got = df.select(audit.span_match_status(
        F.length("t"), F.substring("t", (F.col("s") + 1).cast("int"), (F.col("e") - F.col("s") + 1).cast("int")), F.col("s"), F.col("e"), F.col("q"))).first()[0]
    assert got == status


@pytest.mark.parametrize("spans,n,status", [
    ([], 6, "no_spans"),
    ([(1, 5)], 6, "does_not_start_at_zero"),
    ([(0, 3)], 6, "does_not_end_at_last_char"),
    ([(0, 1), (3, 5)], 6, "gap_or_overlap"),
    ([(0, 2), (3, 5)], 6, "complete_partition"),
])
def test_partition_status(spans_of, entities_of, spans, n, status):
    df = spans_of([("a", i, s, e, "L1") for i, (s, e) in enumerate(spans)])
    ents = entities_of([("a", n, "train")])
    for bounds in ("last", "extent"):
        assert one(geometry.partition_status(df, ents, bounds))["partition_status"] == status
    assert one(geometry.partition_status(df, entities_of([("a", 0, "train")])))["partition_status"] == "missing_text"


@pytest.mark.parametrize("labels,valid", [
    (["Claim", "Position"], False), (["Position", "Lead"], False), (["Position", "Lead", "Lead"], True),
    (["Lead", "Position", "Claim", "Concluding Statement"], True), (["Concluding Statement", "Claim"], False),
])
def test_order_heuristic(spans_of, labels, valid):
    df = spans_of([("a", i, i * 10, i * 10 + 5, x) for i, x in enumerate(labels)])
    assert one(geometry.order_heuristic(df))["order_valid"] is valid


def test_duplicates_count_keys(spans_of):
    df = spans_of([("a", i, 0, 5, "L1") for i in range(3)] + [("a", 9, 6, 8, "L1")])
    assert one(geometry.duplicate_spans(df, SMALL))["duplicate_annotations"] == 1


def features(spans_of, entities_of, rows, n, families, ranks=0):
    return one(structure.structure_features(spans_of(rows), entities_of([("a", n, "train")]), families, SMALL, ranks))


def test_one_span(spans_of, entities_of):
    f = features(spans_of, entities_of, [("a", 0, 0, 9, "L1")], 10, ("firstlast", "transition", "label_position", "geometry"), 3)
    assert f["order_first_is_L1"] == f["order_final_is_L1"] == 1.0
    assert f["order_trans_L1__L1"] == 0.0 and f["order_std_pos_L1"] == 0.0 and f["pos_len_std"] == 0.0
    assert f["order_mean_pos_L1"] == 0.45 and f["pos_end_rank_0"] == 1.0 and f["pos_start_rank_2"] == 0.0


def test_only_gaps_and_no_spans(spans_of, entities_of):
    f = features(spans_of, entities_of, [("a", 0, 0, 9, "gap")], 10, ("count", "firstlast"))
    assert f["count_total_components"] == 0 and f["prop_L1"] == 0 and f["count_unannotated_proportion"] == 1.0
    f = features(spans_of, entities_of, [("b", 0, 0, 9, "gap")], 0, ("count", "geometry"))
    assert all(v == 0 for k, v in f.items() if k != "entity_id")


def test_gap_list_counts_both_sources(spans_of, entities_of):
    rows = [("a", 0, 0, 4, "L1"), ("a", 1, 5, 9, "gap"), ("a", 2, 10, 14, "L2")]
    f = features(spans_of, entities_of, rows, 15, ("geometry",))
    assert f["pos_gap_count"] == 1 and f["pos_gap_len_max"] == pytest.approx(5 / 15)
    rows[1] = ("a", 1, 7, 9, "gap")
    f = features(spans_of, entities_of, rows, 15, ("geometry",))
    assert f["pos_gap_count"] == 2 and f["pos_gap_len_mean"] == pytest.approx((2 + 5) / 2 / 15)
    assert f["pos_gap_len_std"] == pytest.approx(1.5 / 15)


def test_ranks_are_truncated(spans_of, entities_of):
    rows = [("a", i, i, i, "L1") for i in range(5)]
    f = features(spans_of, entities_of, rows, 5, ("geometry",), 2)
    assert "pos_start_rank_2" not in f and f["pos_start_rank_1"] == 0.2
    with pytest.raises(ValueError):
        features(spans_of, entities_of, rows, 5, ("geometry",), 5000)


@pytest.mark.parametrize("n,length,starts,ends", [(1, 9, [0], [8]), (4, 2, [0, 1, 2, 3], [0, 1, 1, 1])])
def test_random_boundaries_special(spark, n, length, starts, ends):
    sizes = spark.createDataFrame([("a", n, length), ("z", 0, 5)], "entity_id string, n bigint, char_count bigint")
    got = controls.random_boundaries(sizes, 13).orderBy("rank").collect()
    assert [r.start_at for r in got] == starts and [r.end_at for r in got] == ends


def test_random_boundaries_tile_even_dense_texts(spark):
    rows = [(f"e{i}", n, length) for i, (n, length) in enumerate([(2, 2), (50, 50), (199, 200), (7, 1000), (90, 100)])]
    sizes = spark.createDataFrame(rows, "entity_id string, n bigint, char_count bigint")
    got = {}
    for r in controls.random_boundaries(sizes, 21).orderBy("entity_id", "rank").collect():
        got.setdefault(r.entity_id, []).append((r.start_at, r.end_at))
    for e, n, length in rows:
        b = got[e]
        assert len(b) == n and b[0][0] == 0 and b[-1][1] == length - 1
        assert all(s <= t for s, t in b) and all(x[1] + 1 == y[0] for x, y in zip(b, b[1:]))


def test_shuffle_is_independent_of_partitioning(spark, spans_of):
    rows = [(f"e{i % 7}", i, i, i, f"L{i * i % 5}") for i in range(200)]
    a = controls.shuffle_labels(spans_of(rows), 5, SMALL)
    b = controls.shuffle_labels(spans_of(rows[::-1]).repartition(3), 5, SMALL)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("y,want", [(2.5, 2), (3.5, 4), (0.2, 1), (7.9, 6)])
def test_clip_and_round(spark, y, want):
    assert spark.range(1).select(clip_and_round(F.lit(y))).first()[0] == want


def test_text_functions(spark):
    def val(c):
        return spark.range(1).select(c).first()[0]

    assert [val(tx.sentence_count(F.lit(t))) for t in ("", "...", "A. B! C?", "a. .b")] == [1, 1, 3, 2]
    assert [val(tx.paragraph_count(F.lit(t))) for t in ("a\n\nb", "a\n \nb", "a\nb", "")] == [2, 2, 1, 1]
    assert val(tx.word_count(F.lit("don't Über_x 3"))) == 4
    assert val(tx.mean_word_length(F.lit("ab abcd"))) == 3.0 and val(tx.mean_word_length(F.lit("!!"))) == 0.0
    assert val(relative_position(F.lit(1), F.lit(2), F.lit(0))) == "0.00–0.00"
    assert val(relative_position(F.lit(1), F.lit(4), F.lit(10))) == "0.10–0.50"
    lens = list(range(1, 300))
    got = val(tx.running_offsets(F.array(*[F.lit(x) for x in lens])))
    assert list(got) == [sum(lens[:i]) for i in range(len(lens))]


def test_head_tail(spark):
    toks = F.array(*[F.lit(i) for i in (1, 2, 3, 4, 5)])
    got = spark.range(1).select(sequences.head_tail(toks, 4, 2, 2), sequences.padded(F.array(F.lit(7)), 3, F.lit(0)),
                                sequences.attention_mask(F.array(F.lit(7)), 3)).first()
    assert list(got[0]) == [1, 2, 4, 5] and list(got[1]) == [7, 0, 0] and list(got[2]) == [1, 0, 0]


def preds(spark, rows):
    return spark.createDataFrame(rows, "condition string, grp string, entity_id string, y_true double, y_pred double")


def brute_kappa(t, p):
    labels = sorted(set(t) | set(p))
    pos = {v: i for i, v in enumerate(labels)}
    n = len(t)
    obs = sum((pos[a] - pos[b]) ** 2 for a, b in zip(t, p)) / n
    exp = sum((pos[a] - pos[b]) ** 2 for a in t for b in p) / n / n
    return None if exp == 0 else 1 - obs / exp


def test_kappa_against_brute_force(spark):
    t = [1, 2, 4, 5, 6, 6, 2, 1, 4]
    p = [1, 4, 4, 5, 5, 6, 2, 2, 6]
    rows = [("c", "g", str(i), float(a), float(b)) for i, (a, b) in enumerate(zip(t, p))]
    got = one(m.metrics(preds(spark, rows)))
    assert got["qwk"] == pytest.approx(brute_kappa(t, p), abs=1e-14)
    value = one(m.kappa(m.score_cells(preds(spark, rows), ["condition"]), ["condition"], labels="value"))["qwk"]
    assert abs(value - got["qwk"]) > 1e-6
    same = [("c", "g", str(i), float(a), float(a)) for i, a in enumerate(t)]
    assert one(m.metrics(preds(spark, same)))["qwk"] == 1.0


def test_kappa_guard(spark):
    assert one(m.group_kappa(preds(spark, [("c", "g", "1", 3.0, 3.0)])))["qwk"] is None
    assert one(m.group_kappa(preds(spark, [("c", "g", "1", 3.0, 3.0), ("c", "g", "2", 3.0, 4.0)])))["qwk"] is None


# Published confusion counts (rows: true 1..6, columns: predicted 1..6) of the
# widest condition, with its published QWK, exact and adjacent accuracy.
GOLDEN = [
    [209, 189, 20, 0, 0, 0],
    [74, 1609, 766, 28, 4, 0],
    [1, 314, 2589, 497, 22, 2],
    [0, 2, 649, 1743, 139, 3],
    [0, 0, 7, 521, 631, 56],
    [0, 0, 0, 10, 149, 167],
]
GOLDEN_QWK, GOLDEN_EXACT, GOLDEN_ADJACENT = 0.8488281675811199, 0.6680126910873955, 0.9904816844534179


def test_published_confusion_gives_published_metrics(spark):
    rows = [("c", t + 1, p + 1, n, 0.0, 0.0) for t, line in enumerate(GOLDEN) for p, n in enumerate(line) if n]
    cells = spark.createDataFrame(rows, "condition string, t bigint, p bigint, n bigint, se double, ae double")
    got = one(m.metrics_from_cells(cells, ["condition"]))
    assert got["n"] == 10401
    assert got["qwk"] == pytest.approx(GOLDEN_QWK, abs=1e-14)
    assert got["exact_accuracy"] == pytest.approx(GOLDEN_EXACT, abs=1e-14)
    assert got["adjacent_accuracy"] == pytest.approx(GOLDEN_ADJACENT, abs=1e-14)


def test_bootstrap_of_equal_conditions_is_zero_and_methods_agree(spark):
    import random

    rng = random.Random(1)
    rows = []
    for i in range(400):
        y = rng.randint(1, 6)
        a, b = y + rng.gauss(0, 0.8), y + rng.gauss(0, 1.2)
        rows += [("A", "g", str(i), float(y), a), ("A2", "g", str(i), float(y), a), ("B", "g", str(i), float(y), b)]
    p = preds(spark, rows)
    zero = one(bootstrap.paired_bootstrap(p, "A", "A2", 50))
    assert zero["qwk_diff_mean"] == zero["ci_lower"] == zero["ci_upper"] == 0 and zero["p_positive"] == 0
    fast = one(bootstrap.paired_bootstrap(p, "A", "B", 2000))
    keyed = one(bootstrap.paired_bootstrap(p, "A", "B", 300, method="keyed"))
    for c in ("qwk_diff_mean", "ci_lower", "ci_upper"):
        assert fast[c] == pytest.approx(keyed[c], abs=0.02)
    again = one(bootstrap.paired_bootstrap(p.repartition(5), "A", "B", 2000))
    assert again == fast


def test_split_falls_back_to_one_stratum(spark):
    rows = [(str(i), "g", 1) for i in range(9)] + [("x", "h", 2)]
    ents = spark.createDataFrame(rows, "entity_id string, grp string, score bigint")
    got = splits.stratified_split(ents).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 8, "validation": 2}


def test_vocabulary_cap_and_tie_break(spark):
    ents = spark.createDataFrame([(str(i), "bb aa cc") for i in range(3)] + [("9", "zz zz zz zz")], "entity_id string, text string")
    vocab = tfidf.fit_vocabulary(tfidf.term_counts(ents), max_features=2, min_df=3).orderBy("term_id").collect()
    assert [r.term for r in vocab] == ["aa", "aa cc"]


def test_pearson_p_values():
    # Two-sided t tails: t = 2.228 at 10 degrees of freedom is p = 0.05.
    t, df = 2.2281388519649385, 10
    assert stats.pearson_p(t / math.sqrt(df + t * t), df + 2) == pytest.approx(0.05, abs=1e-9)
    assert stats.pearson_p(0.0, 50) == pytest.approx(1.0) and stats.pearson_p(1.0, 50) == 0.0


def test_families(spark):
    families = conditions.feature_families(max_ranks=1)
    names = ["surface_word_count", "prop_Lead", "order_trans_Lead__Claim", "order_final_is_Lead", "order_std_pos_Lead",
             "pos_len_mean", "pos_end_rank_0", "rnd_3", "boundary_coverage", "order_x", "Gender_x"]
    df = spark.createDataFrame([(n,) for n in names], "feature_name string")
    got = {r.feature_name: r for r in qa.manifest(df, families).collect()}
    assert [got[n].feature_family for n in names] == ["surface", "count", "transition", "firstlast", "label_position", "position",
                                                      "position", "random", "position", "other", "other"]
    assert [n for n in names if got[n].contains_forbidden_token] == ["Gender_x"]
    assert not {n for c in ("T3_PLUS_POS", "BOUNDARY_ONLY", "RND", "COUNTS_TRANS") for n in conditions.feature_names(c, max_ranks=1)} - set(families)


def test_label_check_and_default_scheme(spans_of):
    df = spans_of([("a", 0, 0, 1, "Lead"), ("a", 1, 2, 3, "Odd"), ("a", 2, 4, 5, "Unannotated")])
    got = one(audit.label_set_check(df, DEFAULT_SCHEME))
    assert got["unexpected"] == "Odd" and "Lead" not in got["missing"].split("|") and "Claim" in got["missing"].split("|")


def test_exemplars_against_picking_one_by_one(spark):
    """Every stratum passes over what was picked before it; strata of issues only look at their first ids."""
    import random

    from spandoc.operators import exemplars

    rng = random.Random(6)
    for n in (6, 40, 400):
        ents = [(f"{i:04d}", rng.randrange(0, 8), f"g{rng.randrange(12)}", f"s{rng.randrange(3)}") for i in range(n)]
        issues = [(e[0], rng.choice(["complete_partition", "gap_or_overlap"]), rng.randrange(0, 12), rng.randrange(0, 2)) for e in ents]
        picked, used = [], set()

        def take(ids, priority, name):
            for i in ids:
                if i not in used:
                    used.add(i)
                    picked.append((i, priority, name))

        def greedy(cond, k, priority, name):
            take([e[0] for e in ents if cond(e) and e[0] not in used][:k], priority, name)

        for s in range(1, 7):
            greedy(lambda e: e[1] == s, 1, 1, f"score={s}")
        for g in sorted({e[2] for e in ents})[:8]:
            greedy(lambda e: e[2] == g, 1, 2, f"grp={g}")
        for g in sorted({e[3] for e in ents}):
            greedy(lambda e: e[3] == g, 2, 3, f"subgrp={g}")
        for priority, name, k, cond in ((4, "complex", 3, lambda r: r[2] >= 8), (5, "simple", 2, lambda r: r[2] <= 4),
                                        (6, "bad_partition", 3, lambda r: r[1] != "complete_partition"), (7, "overlapping", 2, lambda r: r[3] > 0)):
            take([r[0] for r in issues if cond(r)][:k], priority, name)
        greedy(lambda e: True, max(0, 20 - len(picked)), 8, "fill")
        got = exemplars.select_exemplars(
            spark.createDataFrame(ents, "entity_id string, score int, grp string, subgrp string").repartition(3),
            spark.createDataFrame(issues, "entity_id string, partition_status string, annotated_segments int, overlap_pairs int"))
        assert [tuple(r) for r in got.collect()] == picked


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_statuses_of_an_entity_with_many_spans(spark, monkeypatch, broadcast):
    text = "".join(chr(97 + i % 26) for i in range(500))
    rows = [("hot", i, i, i + 4, text[i:i + 5] if i % 3 else "no", "Claim") for i in range(498)]
    rows += [("cold", 0, 0, 1, "ab", "Claim"), ("untold", 0, 0, 1, "ab", "Claim"), (None, 0, 0, 1, "ab", "Claim")]
    spans = spark.createDataFrame(rows, "entity_id string, k bigint, start_at bigint, end_at bigint, span_text string, label string")
    texts = spark.createDataFrame([("hot", text), ("cold", "abc")], "entity_id string, text string")
    want = sorted(map(str, audit.match_statuses(spans, texts).collect()))
    assert len(want) == len(rows)
    monkeypatch.setattr(audit, "SPANS_PER_ROW", 50)
    monkeypatch.setattr(audit, "BROADCAST_ENTITIES", broadcast)
    assert sorted(map(str, audit.match_statuses(spans, texts).collect())) == want
    held = audit._dealt(spans).groupBy("entity_id", "slot").count().collect()
    assert max(r["count"] for r in held) <= 100 and sum(r["count"] for r in held) == len(rows)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_consolidation_never_collects_sets_beside_texts(spark):
    rows = spark.createDataFrame(
        [("a", 1, None, 2.0, "x", "b.csv"), ("a", 2, "two", 2.0, "x", "b.csv"), ("a", 9, "one", None, "y", "a.csv"),
         ("b", 1, "t", None, "x", "a.csv"), ("b", 1, "t", None, "x", "a.csv")],
        "entity_id string, row_no bigint, text string, score double, split string, source_file string").selectExpr(
        "*", "'g' AS grp", "'s' AS subgrp", "1.0D AS grade", "5L AS word_count_field", "'Lead' AS label", "'Effective' AS effectiveness")
    out = audit.consolidate(rows)
    got = {r.entity_id: r for r in out.collect()}
    assert (got["a"].text, got["a"].split, got["a"].source_files) == ("one", "x|y", "a.csv|b.csv")
    assert [(got[e].annotation_count, got[e].text_variant_count, got[e].score_variant_count) for e in "ab"] == [(3, 2, 1), (2, 1, 0)]
    # Spark sorts all rows of an aggregate that collects sets once it meets more than 128 keys.
    assert not [line for line in _plan(out).splitlines() if "ObjectHashAggregate" in line and "min_by" in line]


def test_small_annotation_tables_reach_consolidation_in_order(spark, tmp_path):
    from spandoc.catalog import load_catalog

    docs = [(i, f"line one of {i}\nline two\n\nline four", "web", "en", 900 * i) for i in range(6)] + [(7, None, None, "en", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = load_catalog()[0]["join_validation"](spark, str(tmp_path))
    assert sorted((r.entity_id, r.annotation_count, r.has_full_text) for r in out.collect()) == [(str(i), 3, True) for i in range(6)]
    # A sort right below the aggregate of the texts would hold one text per span.
    lines = _plan(out).split("== Initial Plan ==")[0].splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines) if "partial_min_by(text" in line]
    assert len(below) == 1 and " Sort [" not in below[0]


def test_terms_are_counted_in_rows_and_normed_without_sorting(spark):
    ents = spark.createDataFrame([("a", "Bb aa bb aa x"), ("b", None), ("c", ""), ("d", "cc")], "entity_id string, text string")
    counts = tfidf.term_counts(ents)
    assert sorted(tuple(r) for r in counts.collect()) == [
        ("a", "aa", 2), ("a", "aa bb", 1), ("a", "bb", 2), ("a", "bb aa", 2), ("d", "cc", 1)]
    assert "HashAggregate" not in _plan(counts)
    weights = tfidf.fit_tfidf(counts, 4, 100, 1).transform(counts)
    assert "Window" not in _plan(weights)
    assert weights.filter("entity_id = 'd'").first().weight == pytest.approx(1.0)


def test_terms_of_repeated_and_null_ids_are_added_up(spark):
    ents = spark.createDataFrame([("a", "aa bb"), ("a", "bb aa"), (None, "cc dd"), (None, "cc"), ("d", "cc")], "entity_id string, text string")
    counts = tfidf.term_counts(ents)
    assert sorted((r.entity_id or "", r.term, r.tf) for r in counts.collect()) == [
        ("", "cc", 2), ("", "cc dd", 1), ("", "dd", 1), ("a", "aa", 2), ("a", "aa bb", 1), ("a", "bb", 2), ("a", "bb aa", 1), ("d", "cc", 1)]
    squares = tfidf.fit_tfidf(counts, 3, 100, 1).transform(counts).groupBy("entity_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert len(squares) == 3 and all(r.s == pytest.approx(1.0) for r in squares)


def test_annotation_files_that_repeat_texts_are_compressed(spark, tmp_path):
    from spandoc.schemas import ANNOTATION_SCHEMA
    from spandoc.sources import tables

    text = 'two\nlines, "quoted" ' * 200
    rows = spark.range(500).select(*[
        (F.lit(text) if f.name == "full_text" else F.col("id") if f.name == "essay_id" else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in ANNOTATION_SCHEMA]).coalesce(1)
    tables.save(rows, str(tmp_path / "c"), "csv", compression="gzip")
    assert sum(p.stat().st_size for p in (tmp_path / "c").glob("part-*")) < 500 * len(text) / 20
    back = tables.read_annotations(spark, [str(tmp_path / "c")])
    assert back.count() == 500 and {r.full_text for r in back.select("full_text").distinct().collect()} == {text}
