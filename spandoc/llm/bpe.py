"""Byte-level BPE: ranks replayed over an inverted index of token pairs."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Pieces a worker remembers, and characters of text whose new pieces are encoded together.
REMEMBERED, CHUNK = 150_000, 2_000_000
# The same where a stage shares its executors with others.
SMALL_REMEMBERED, SMALL_CHUNK = 60_000, 500_000
DECODED_ROWS = 2000
MANY = 64  # places of a rank that are merged together


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks file of a public tokenizer: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Replay:
    """Encodes a corpus of distinct pieces by replaying the merges in rank order.

    All pieces lie in one linked list of tokens.  ``where`` is the inverted index: for each rank the
    places whose token and right neighbour merge into that rank.  The lowest rank present is taken
    next and merged at all its places; each merge only re-indexes its two neighbours.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values(), default=-1) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.double = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)
        self.pairs: dict[int, int] = {}

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what each pair merges into, -1 if it does not (or one side is no token)."""
        keys = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        back = None
        if len(keys) > 24:
            keys, back = np.unique(keys, return_inverse=True)
        known, tokens, out = self.pairs, self.tokens, []
        for key in keys.tolist():
            rank = known.get(key)
            if rank is None:
                rank = -1 if key < 0 else self.ranks.get(tokens[key // self.size] + tokens[key % self.size], -1)
                known[key] = rank
            out.append(rank)
        found = np.array(out, np.int64)
        return found if back is None else found[back]

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        open_ = [p for p, rank in zip(pieces, whole.tolist()) if rank < 0]
        flat, sizes = self._merge(open_)
        lengths = np.ones(len(pieces), np.int64)
        lengths[whole < 0] = sizes
        out = np.empty(lengths.sum(), np.int32)
        single = np.repeat(whole >= 0, lengths)
        out[single] = whole[whole >= 0]
        out[~single] = flat
        return out, lengths

    def _merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not pieces:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        # One more byte per piece for the mark that ends it; place -1 is the last mark.
        raw = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        inside = np.ones(len(raw), bool)
        inside[ends] = False
        piece = np.cumsum(~inside)
        token = np.where(inside, self.single[raw], -1)
        after, before = np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1)
        # Few places of a rank are merged one by one, many at once.
        few: dict[int, list[int]] = {}
        many: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def index(places: np.ndarray, ranks: np.ndarray) -> None:
            fine = ranks >= 0
            places, ranks = places[fine], ranks[fine]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            if not len(places):
                return
            starts = np.concatenate([[0], np.flatnonzero(ranks[1:] != ranks[:-1]) + 1])
            for rank, first, end in zip(ranks[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(places)]):
                if rank not in few and rank not in many:
                    heappush(heap, rank)
                if end - first < MANY:
                    few.setdefault(rank, []).extend(places[first:end].tolist())
                else:
                    many.setdefault(rank, []).append(places[first:end])

        # The same arrays, fast to read and write one element at a time.
        token_at, after_at, before_at = memoryview(token), memoryview(after), memoryview(before)
        size, known, ranks, tokens = self.size, self.pairs, self.ranks, self.tokens

        def rank_of(left: int, right: int) -> int:
            key = left * size + right
            rank = known.get(key)
            if rank is None:
                rank = known[key] = ranks.get(tokens[left] + tokens[right], -1)
            return rank

        def merge_many(rank: int, i: np.ndarray) -> None:
            i = i[token[i] >= 0]
            j = after[i]
            same = self._pair_ranks(token[i], token[j]) == rank  # else a neighbour was merged away meanwhile
            i, j = i[same], j[same]
            valid = i
            if len(i) > 1:
                linked = np.concatenate([[False], j[:-1] == i[1:]])
                if linked.any():  # pairs that share a token: from left to right, every other one
                    at = np.arange(len(i))
                    even = (at - np.maximum.accumulate(np.where(linked, 0, at))) % 2 == 0
                    i, j = i[even], j[even]
            if not len(i):
                return
            k = after[j]
            merged = np.full(len(i), rank)
            right, left = self._pair_ranks(merged, token[k]), self._pair_ranks(token[before[i]], merged)
            soon = (right >= 0) & (right < rank) | (left >= 0) & (left < rank)
            twice = rank_of(rank, rank)
            if 0 <= twice < rank:
                soon[:] = True
            if soon.any():  # a new pair may go before the other places of its piece: merge the first one only
                of = piece[i]
                now = ~(np.isin(of, of[soon]) & np.concatenate([[False], of[1:] == of[:-1]]))
                later = np.setdiff1d(valid[np.isin(piece[valid], of[soon])], i[now])
                i, j, k, merged = i[now], j[now], k[now], merged[now]
                index(later, np.full(len(later), rank))
                right, left = right[now], left[now]
            token[i], token[j] = rank, -2
            after[i] = k
            before[k] = i
            h = before[i]
            # Two merges side by side see each other.
            right[token[k] == rank] = twice
            left[token[h] == rank] = twice
            index(np.concatenate([i, h]), np.concatenate([right, left]))

        def merge_few(rank: int, places: list[int]) -> None:
            places.sort()
            for done, i in enumerate(places, 1):
                j = after_at[i]
                left, right = token_at[i], token_at[j]
                if left < 0 or right < 0 or rank_of(left, right) != rank:
                    continue  # a neighbour was merged away meanwhile
                token_at[i], token_at[j] = rank, -2
                k = after_at[i] = after_at[j]
                before_at[k] = i
                h = before_at[i]
                lowest = size
                for place, left, right in ((i, rank, token_at[k]), (h, token_at[h], rank)):
                    if left >= 0 and right >= 0:
                        new = rank_of(left, right)
                        if new >= 0:
                            if new in few:
                                few[new].append(place)
                            else:
                                few[new] = [place]
                                if new not in many:
                                    heappush(heap, new)
                            if new < lowest:
                                lowest = new
                if lowest < rank and done < len(places):  # the new pair goes first
                    if rank not in few and rank not in many:
                        heappush(heap, rank)
                    few.setdefault(rank, []).extend(places[done:])
                    return

        index(np.arange(len(raw) - 1), np.where(inside[:-1] & inside[1:], self.double[raw[:-1], raw[1:]], -1))
        while heap:
            rank = heappop(heap)
            places, blocks = few.pop(rank, []), many.pop(rank, [])
            if not blocks and len(places) < MANY:
                merge_few(rank, places)
            else:
                merge_many(rank, np.unique(np.concatenate([*blocks, np.array(places, np.int64)])))
        left = token[token != -2]
        cuts = np.flatnonzero(left == -1)
        return left[left >= 0], np.diff(np.concatenate([[-1], cuts])) - 1


class Pieces(dict):
    """Piece -> number, in order of first use; ``fresh`` lists those without ids yet."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.fresh.append(piece)
        return number


class Memory:
    """The pieces that a worker has encoded, kept from task to task; when they are too many, the rarer ones are forgotten."""

    held: "Memory | None" = None

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.replay = ranks, Replay(ranks)
        self.pieces = Pieces()
        self.ids = np.empty(0, np.int32)
        self.starts, self.lengths, self.uses = (np.empty(0, np.int64) for _ in range(3))

    def forget(self, most: int) -> None:
        """Keep the third of ``most`` pieces that were used most."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[:most // 3])
        names = list(self.pieces)
        self.pieces = Pieces()
        self.pieces.update((names[i], n) for n, i in enumerate(kept.tolist()))
        size = self.lengths[kept]
        done = np.cumsum(size)
        self.ids = self.ids[np.arange(size.sum()) + np.repeat(self.starts[kept] - (done - size), size)]
        self.starts, self.lengths, self.uses = done - size, size, self.uses[kept]

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> "Memory":
        if cls.held is None or cls.held.ranks is not ranks:
            cls.held = cls(ranks)
        return cls.held

    def encode(self, texts: list[str], find, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        if len(self.pieces) > (most or REMEMBERED):
            self.forget(most or REMEMBERED)
        number = self.pieces.__getitem__
        used = [np.fromiter(map(number, find(t)), np.int32) for t in texts]
        ids, lengths = self.replay.encode([p.encode() for p in self.pieces.fresh])
        self.pieces.fresh.clear()
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])
        flat = np.concatenate(used)
        self.uses = np.bincount(flat, minlength=len(self.pieces)) + np.concatenate([self.uses, np.zeros(len(lengths), np.int64)])
        size = self.lengths[flat]
        done = np.cumsum(size)
        out = self.ids[np.arange(done[-1] if len(done) else 0) + np.repeat(self.starts[flat] - (done - size), size)]
        ends = np.concatenate([[0], done])[np.cumsum([len(u) for u in used])]
        return out, np.diff(np.concatenate([[0], ends]))


def encode(entities: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Token ids of every text.

    ``entities`` has ``entity_id`` and ``text`` (other columns are ignored; null counts as empty); the
    result has entity_id and ids (array<int>) per input row.  ``pattern`` cuts a text into pieces, each
    is encoded by itself; special tokens are ordinary text.  The corpus of a replay is what a task
    reads at once: the distinct pieces of some CHUNK characters that its worker does not remember.
    """
    rows = entities.select("entity_id", "text")
    schema = T.StructType([rows.schema["entity_id"], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    shared = entities.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        memory = Memory.of(shared.value)
        for b in batches:
            texts = b.column(1)
            part, size = [], 0
            for i, t in enumerate(texts, 1):
                part.append(t.as_py() or "")
                size += len(part[-1])
                if size >= CHUNK or i == len(texts):
                    ids, counts = memory.encode(part, find)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(i - len(part), len(part)), pa.ListArray.from_arrays(offsets, ids)], ["entity_id", "ids"])
                    part, size = [], 0

    return rows.mapInArrow(run, schema)


class Surfaces:
    """The bytes of all tokens one after another, to join those of many ids at once."""

    def __init__(self, tokens: list[bytes]):
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def join(self, ids: np.ndarray, counts: np.ndarray, valid: pa.Buffer | None = None) -> pa.BinaryArray:
        """One binary value per count of ids; unknown ids are an error."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.lengths) and self.lengths[ids].all()):
            raise ValueError("ids beyond the vocabulary")
        size = self.lengths[ids]
        done = np.cumsum(size)
        text = self.raw[np.arange(done[-1] if len(done) else 0) + np.repeat(self.starts[ids] - (done - size), size)]
        ends = np.concatenate([[0], done])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [valid, pa.py_buffer(ends), pa.py_buffer(text)])


def _tokens(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the tokens in ``ids``; null ids give null.  Unknown ids are an error."""
    rows = encoded.select("entity_id", "ids")
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())])
    shared = encoded.sparkSession.sparkContext.broadcast(_tokens(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surfaces = Surfaces(shared.value)
        for b in batches:
            for lo in range(0, len(b), DECODED_ROWS):
                part = b.slice(lo, DECODED_ROWS)
                column = part.column(1)
                ids = column.flatten().to_numpy(zero_copy_only=False)
                rows = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                valid = pa.py_buffer(np.packbits(column.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, surfaces.join(ids, rows, valid)], [*b.schema.names, "decoded"])

    return rows.mapInArrow(run, schema)


def round_trip(entities: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``encode`` and ``decode`` in one pass over the texts: entity_id, ids, decoded.

    One Python worker per task does both, with small parts and fewer remembered pieces, and forgets
    them with its last row: for jobs that share their executors' memory with other stages.
    """
    rows = entities.select("entity_id", "text")
    schema = T.StructType([
        rows.schema["entity_id"], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())])
    shared = entities.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        memory, surfaces = Memory(shared.value), Surfaces(_tokens(shared.value))
        for b in batches:
            texts = b.column(1)
            part, size = [], 0
            for i, t in enumerate(texts, 1):
                part.append(t.as_py() or "")
                size += len(part[-1])
                if size >= SMALL_CHUNK or i == len(texts):
                    ids, counts = memory.encode(part, find, SMALL_REMEMBERED)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(i - len(part), len(part)), pa.ListArray.from_arrays(offsets, ids), surfaces.join(ids, counts)],
                        ["entity_id", "ids", "decoded"])
                    part, size = [], 0

    return rows.mapInArrow(run, schema)


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
