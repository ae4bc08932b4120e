"""Piece encoding, vector codes and filter interactions against plain Python on small entities."""

import random
import struct
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spandoc.llm import codes, interactions, pieces, queries

SF = "/root/testdata/sf0.001"


# pieces


@pytest.fixture(scope="module")
def model():
    P = pytest.importorskip("public_tokenizers")
    return pieces.read_model(P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library(model):
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_proto=model.file)


def odd_texts():
    rng = random.Random(3)
    parts = [*"ab the▁ \n\t0159.,'é中ßЖ́😀\x00", " the", "ing", "  ", "    ", "<s>", "</s>", "<0x0A>", "<unk>", "\r\n"]
    out = [None, "", " ", "  a  ", "▁", "a", "Hello world", "中文" * 50, " " * 1000, "é" * 5000, "ab" * 40_000]
    return out + ["".join(rng.choices(parts, k=rng.randrange(0, 40))) for _ in range(400)]


def test_pieces_are_those_of_the_library(spark, model, library):
    texts = odd_texts()
    rows = [(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts)] * 2  # repeated rows, null ids
    frame = spark.createDataFrame(rows, "entity_id bigint, text string, ids string, score int").repartition(3)
    got = pieces.round_trip(frame, model).collect()
    want = [library.encode(t or "", add_bos=True, add_eos=True) for _, t, _, _ in rows]
    assert sorted(bytes(r.ids) for r in got) == sorted(struct.pack(f"<{len(w)}I", *w) for w in want)
    assert all(r.agrees for r in got)
    assert {(bytes(r.ids), r.decoded) for r in got} == {(struct.pack(f"<{len(w)}I", *w), library.decode(w)) for w in want}
    # Encoding and decoding by themselves.
    encoded = pieces.encode_pieces(frame, model, check=False)
    assert encoded.columns == ["entity_id", "text", "ids", "agrees"] and encoded.filter("agrees IS NOT NULL").isEmpty()
    again = pieces.decode_pieces(encoded, model).withColumn("list", pieces.unpacked(F.col("ids"))).collect()
    assert sorted((tuple(r.list), r.decoded) for r in again) == sorted((tuple(w), library.decode(w)) for w in want)


def test_any_ids_decode_as_in_the_library(spark, model, library):
    rng = random.Random(4)
    some = [0, 1, 2, 3, 13, 130, 198, 200, 230, 255, 258, 259, 260, 264, 28705, 29000, 31999]
    lists = [[rng.choice(some) for _ in range(rng.randrange(0, 9))] for _ in range(500)]
    rows = [(i, struct.pack(f"<{len(x)}I", *x)) for i, x in enumerate(lists)] + [(None, None)]
    got = {r.entity_id: r.decoded for r in pieces.decode_pieces(spark.createDataFrame(rows, "entity_id bigint, ids binary"), model).collect()}
    assert got == {**{i: library.decode(x) for i, x in enumerate(lists)}, None: None}


def test_segments_are_remembered_within_bounds(model, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    codec = pieces.Codec(model)
    texts = [t or "" for t in odd_texts()[:100]]
    assert [codec.encode(t) for t in texts] == codec.by_library(texts)
    assert len(codec.segments) <= 5 and len(codec.segments.older) <= 5


def test_agenda_by_hand(model):
    """Best score first, ties from the left; a vocabulary with pieces across spaces is one segment."""
    small = pieces.PieceModel(("<unk>", "<s>", "</s>", "a", "b", "ab", "ba", "aba", "b▁"), (0, 0, 0, -9, -9, -2, -2, -1, -3),
                              (2, 3, 3, 1, 1, 1, 1, 1, 1), 1, 2, 0, " ? ", False, False, b"")
    segments = pieces.Segments(small)
    assert segments.find("ab ab") == ["ab ab"]
    assert segments.merge("abab") == ["aba", "b"] and segments.merge("bab") == ["ba", "b"] and segments.merge("ba▁b") == ["ba", "▁", "b"]
    codec = pieces.Codec(small)
    assert np.frombuffer(codec.encode("zzazz"), "<u4").tolist() == [1, 0, 3, 0, 2]
    assert codec.decode(codec.encode("az")) == "a ? "


def test_pieces_of_empty_tables_and_wrong_ids(spark, model):
    assert pieces.round_trip(spark.createDataFrame([], "entity_id bigint, text string"), model).count() == 0
    wrong = spark.createDataFrame([(1, struct.pack("<I", 32000))], "entity_id bigint, ids binary")
    with pytest.raises(Exception, match="vocabulary"):
        pieces.decode_pieces(wrong, model).collect()


def test_pieces_of_the_documents(spark, model, library):
    docs = {d.doc_id: d.text or "" for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_sentencepiece"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.agrees) == (len(ids), sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), True)
        assert r.decoded_sha256 == sha256(library.decode(ids).encode()).hexdigest()


# vector codes


@pytest.mark.parametrize("bits", [1, 12, 25, 26, 30])
def test_limb_products_are_exact(bits):
    rng = np.random.default_rng(bits)
    a, b = (rng.integers(-(1 << bits), (1 << bits) + 1, (7, 5)) for _ in range(2))
    a[0], b[0] = -(1 << bits), 1 << bits
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    got = codes.limb_products(a, b)
    assert got.dtype == np.int64 and all(abs(v) < 1 << 63 for r in want for v in r) and got.tolist() == want


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    """(code, error) per row, and the codebooks, in plain integers."""
    from math import floor, isfinite

    kept = [(i, [floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            found = []
            for p in range(parts):
                d = [sum((a - b) ** 2 for a, b in zip(c[p], e)) for e in books[p]]
                found.append((d.index(min(d)), min(d)))
            out.append(found)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p][0] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((i is None, i or 0, "".join(f"{e:02x}" for e, _ in f), sum(d for _, d in f)) for (i, _), f in zip(kept, assign())), books


def vectors(n, rng):
    out = [(i, [rng.choice([-2.5, -0.25, 0.0, 0.1, 0.5, 3.0]) + rng.random() * (i % 3) for _ in range(8)]) for i in range(n)]
    out += [(3, out[5][1]), (3, out[5][1]), (None, out[7][1])]  # repeated ids and rows, null id
    return out


@pytest.mark.parametrize("n, entries", [(60, 8), (60, 256), (2, 4)])
def test_codes_against_plain_integers(spark, n, entries):
    rng = random.Random(n)
    rows = vectors(max(n, 8), rng)[:n] if n < 8 else vectors(n, rng)
    bad = [(900, None), (901, [None] * 8), (902, [float("nan")] + [0.0] * 7), (903, [float("inf")] * 8)]
    frame = spark.createDataFrame([(i, v, "ab"[(i or 0) % 2] if (i or 0) % 3 else None, 1) for i, v in rows + bad],
                                  "entity_id bigint, embedding array<double>, grp string, code int").repartition(3)
    found = codes.compress_vectors(frame, entries=entries)
    want, books = codes_by_hand(rows, entries=entries)
    got = found.codes.collect()
    assert sorted((r.entity_id is None, r.entity_id or 0, r.code, r.error) for r in got) == want
    assert found.codebooks.tolist() == books
    assert found.codebooks_text() == ",".join(str(x) for b in books for e in b for x in e)
    for r in got:
        assert r.grp_error == sum(o.error for o in got if o.grp == r.grp)


def test_codes_of_other_lengths_large_numbers_and_empty_tables(spark):
    schema = "entity_id bigint, embedding array<float>, grp int"
    rows = [(1, [0.5] * 4, 1), (2, [0.25] * 4, None), (3, [1.0] * 8, 1), (4, [], 1), (5, [1e30] * 4, None), (6, [1.0] * 3, 2)]
    found = codes.compress_vectors(spark.createDataFrame(rows, schema))
    got = {r.entity_id: (r.code, r.error, r.grp_error) for r in found.codes.collect()}
    assert got == {1: ("00000000", 0, 0), 2: ("01010101", 0, 0), 3: (None, None, 0), 4: (None, None, 0),
                   5: (None, None, 0), 6: (None, None, None)}
    assert found.codebooks[0].tolist() == [[512], [256]]
    for none in ([], [(1, None, 1)], [(1, [], 1)]):
        empty = codes.compress_vectors(spark.createDataFrame(none, schema))
        assert [r.code for r in empty.codes.collect()] == [None] * (none == [(1, [], 1)]) and empty.codebooks_text() == ""
    with pytest.raises(ValueError):
        codes.compress_vectors(spark.createDataFrame(rows, schema), entries=257)


# filter interactions


def interactions_by_hand(rows, names):
    """rows: (group, set of failed names, set of losses); result as {(group, order, step): counts}."""
    out = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        removed_in_all = dict.fromkeys(names, 0)
        for order in permutations(names):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in own) - len(gone)
                left = [r for r in left if f not in r[1]]
                removed_in_all[f] += len(gone)
                out[g, "".join(order), k + 1] = [len(left), len(gone), redundant, sum(r[1] == {f} for r in own),
                                                 sum("good" in r[2] for r in gone), sum("toxic" in r[2] for r in gone)]
        for (group, order, step), counts in out.items():
            if group == g:
                counts.append(removed_in_all[order[step - 1]])
    return out


def test_interactions_against_every_order(spark):
    rng = random.Random(8)
    names = "ABCDE"
    rows = []
    for _ in range(150):
        fails = {n for n in names if rng.random() < 0.35}
        rows.append((rng.choice(["x", "x", "x", "y", None, ""]), fails, {n for n in ("good", "toxic") if rng.random() < 0.4}))
    rows += [("clean", set(), {"good"})] * 3 + [("bad", set(names), set())]
    table = [(rng.choice([1, 2, None]), g, *[(n in f) or (None if rng.random() < 0.5 else False) for n in names],
              ("good" in m) or None, "toxic" in m, "extra") for g, f, m in rows]
    schema = "entity_id int, grp string, " + ", ".join(f"{n} boolean" for n in names) + ", good boolean, toxic boolean, row string"
    frame = spark.createDataFrame(table, schema).repartition(4)
    got = interactions.filter_interactions(frame, {n: F.col(n) for n in names}, {"good": F.col("good"), "toxic": F.col("toxic")})
    want = interactions_by_hand([(g or "", f, m) for g, f, m in rows], names)
    assert {(r.grp, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
            for r in got.collect()} == want


def test_one_filter_without_losses_and_empty_tables(spark):
    frame = spark.createDataFrame([("g", 1), ("g", 2), (None, 3)], "grp string, score int")
    got = interactions.filter_interactions(frame, {"low": F.col("score") < 2}, {})
    assert sorted(tuple(r) for r in got.collect()) == [("", "low", 1, 1, 0, 0, 0, 0), ("g", "low", 1, 1, 1, 0, 1, 1)]
    assert interactions.filter_interactions(frame.filter("score > 5"), {"low": F.col("score") < 2, "b": F.lit(True)}, {}).count() == 0
    with pytest.raises(ValueError):
        interactions.filter_interactions(frame, {}, {})


def test_text_failures(spark):
    fifty = " ".join(f"w{i}" for i in range(50))
    rows = [(1, fifty), (2, fifty), (None, fifty), (2, fifty + " "), (3, None), (4, ""), (5, "\x0bA\tb\n"), (6, "x " * 60), (7, "50 %"),
            (8, "Ab" + "c" * 18), (9, "Ab" + "c" * 19), (10, "x y")]
    frame = spark.createDataFrame([(i, t, "s", "e") for i, t in rows], "entity_id int, text string, source string, digest string")
    got = {(r.entity_id, r.source, "".join(n for n in "ABCDE" if r[n])) for r in interactions.text_failures(frame, "source").collect()}
    assert got == {(1, "s", ""), (2, "s", "E"), (None, "s", ""), (2, "s", ""), (3, "s", "A"), (4, "s", "AE"), (5, "s", "AC"),
                   (6, "s", "B"), (7, "s", "AD"), (8, "s", "A"), (9, "s", "A"), (10, "s", "A")}
