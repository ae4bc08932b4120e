"""The registered queries against DuckDB, and the pipeline against its stages by hand."""

import pytest

import corpus_pipeline
import verify
from spandoc.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return verify.duck(SF)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    msg = verify.compare(name, queries.QUERIES[name](spark, SF), duck, queries.ORACLES[name])
    assert msg.startswith("ok") and "TYPES" not in msg, msg


def test_near_copies_of_the_documents(spark):
    from tests.llm.test_operators import classes_by_hand, print_by_hand

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    prints = {d.doc_id: print_by_hand(d.text) for d in docs}
    want = {i: (f"{prints[i]:016x}", c) for i, c in classes_by_hand(prints).items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op4_simhash_near_dedup"](spark, SF).collect()}
    assert got == want


def test_quality_of_the_documents(spark):
    rows = queries.QUERIES["op7_quality_classifier"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = rows.filter("held_out").join(labels, "doc_id").collect()
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) / len(held) > 0.95


def test_tokens_of_the_documents(spark):
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    from hashlib import sha256

    known = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=queries.tokenizer(), special_tokens={})
    docs = {d.doc_id: d.text or "" for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op9_byte_bpe"](spark, SF).collect():
        ids = known.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == sha256(docs[r.doc_id].encode()).hexdigest()


def test_round_trip_is_encoding_and_decoding(spark, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from spandoc.llm import bpe

    monkeypatch.setattr(bpe, "SMALL_REMEMBERED", 300)
    monkeypatch.setattr(bpe, "SMALL_CHUNK", 5000)
    ranks, texts = queries.tokenizer(), queries.entities(spark, SF)
    texts = texts.unionByName(spark.createDataFrame([(None, None), (-1, "")], "entity_id bigint, text string"))
    want = {(r.entity_id, tuple(r.ids), bytes(r.decoded)) for r in bpe.decode(bpe.encode(texts, ranks, P.PATTERN), ranks).collect()}
    assert {(r.entity_id, tuple(r.ids), bytes(r.decoded)) for r in bpe.round_trip(texts, ranks, P.PATTERN).collect()} == want


def test_main_text_of_the_pages(spark):
    import html
    import re

    pages = {p.page_id: p.html for p in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.QUERIES["op6_main_text"](spark, SF).collect():
        inner = re.search("<article>(.*)</article>", pages[r.page_id], re.DOTALL)[1].replace("<br>", " ")
        parts = re.split("</?(?:h1|p)>", re.sub("</?b>", "", inner))
        want = "\n".join(filter(None, (" ".join(html.unescape(p).split()) for p in parts)))
        assert (r.text, r.n_chars) == (want, len(want))


def test_pipeline_against_its_stages_by_hand(spark):
    from tests.llm.test_operators import contaminated_by_hand, lines_by_hand, similar_by_hand

    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    scores = {r.doc_id: r.predicted for r in queries.QUERIES["op7_quality_classifier"](spark, SF).collect()}
    rows = [(i, t) for i, t in docs.items() if scores[i]]
    texts = {e: t for e, t, _, _ in lines_by_hand(rows)}
    classes = dict(zip(texts, similar_by_hand(list(texts.items()))))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i: t for i, t in texts.items() if classes[i] == i and not contaminated_by_hand(t, items)[-1]}
    got = {r.doc_id: r.text for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < len(docs)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", "s", 0), (2, "", None, None, None), (2, "", None, None, None), (None, "x", "de", "s", 1), (3, "y" * 200_000, "en", "s", 5)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        assert out.limit(1).count() <= 1 and stage(spark, docs.limit(0), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 5


def test_near_copies_under_repeated_and_null_ids_leave_too(spark):
    """One row of a class stays, whichever of its rows share an id with others."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, long), (2, long + " more"), (2, "another text of id two"),  # the second is a copy of 1, the third is not
        (3, "x " + long[3:]), (5, "Words and words"), (5, "words  AND words"), (5, "words and words"),
        (7, " ".join(f"v{i}" for i in range(40))), (7, " ".join(f"v{i}" for i in range(41))), (7, "last"), (7, "last"),
        (None, long), (None, "of null ids only"), (None, "of null  ids only"), (None, "alone"), (9, None), (9, ""), (8, "last")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()), key=str)
    chosen = [t for i, t in got if i == 7 and t != "last"]
    assert len(chosen) == 1 and chosen[0] in (rows[7][1], rows[8][1])
    assert got == sorted([(1, long), (2, rows[2][1]), (5, "Words and words"), (7, "last"), (7, chosen[0]),
                          (None, "of null  ids only"), (None, "alone"), (9, None)], key=str)
