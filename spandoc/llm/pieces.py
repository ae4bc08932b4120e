"""SentencePiece encoding and decoding: merges taken from a score-ordered agenda of adjacent symbols."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from sys import byteorder

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

SPACE = "▁"  # fixed value: how the vocabulary writes a space
# Segments a worker remembers (twice as many at most), and characters of text that go out together.
REMEMBERED, CHUNK = 400_000, 2_000_000
# Neighbours of the symbols of a short segment, to be copied.
SHORT = 64
AFTER, BEFORE = list(range(1, SHORT + 1)), list(range(-1, SHORT - 1))
# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


@dataclass(frozen=True)
class PieceModel:
    """What a merge-type model file says; ``file`` is the file itself, for the library."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    begin: int
    end: int
    unknown: int
    unknown_text: str
    prefix: bool
    byte_fallback: bool
    file: bytes


def read_model(path: str) -> PieceModel:
    """A model of merge type with identity normalization; anything else is a ValueError."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        raw = f.read()
    model = sentencepiece_model_pb2.ModelProto.FromString(raw)
    train, norm = model.trainer_spec, model.normalizer_spec
    kinds = tuple(p.type for p in model.pieces)
    if train.model_type != train.BPE or train.treat_whitespace_as_suffix or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("not a merge-type vocabulary of normal, byte, control and unknown pieces")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("the model changes texts before it encodes them")
    return PieceModel(
        tuple(p.piece for p in model.pieces), tuple(p.score for p in model.pieces), kinds, train.bos_id, train.eos_id,
        train.unk_id, train.unk_surface, norm.add_dummy_prefix, train.byte_fallback, raw)


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def _ranks(scores: dict[str, float]) -> dict[str, int]:
    """Place of a piece's score among all scores, the best first; equal scores share it."""
    place = {score: r for r, score in enumerate(sorted(set(scores.values()), reverse=True))}
    return {p: place[score] for p, score in scores.items()}


def _segment_pattern(long: list[str]) -> str:
    """Cuts a text where no piece of two or more characters can reach across.

    Characters that some piece holds side by side belong together, and so on from piece to piece; a run of such a
    family, with the spaces before it, is a segment.  Characters of no family stand alone.
    """
    if any(SPACE in p.lstrip(SPACE) for p in long):
        return r"(?s:.+)"
    family = {c: {c} for p in long for c in p.lstrip(SPACE)}
    for p in long:
        for a, b in zip(p.lstrip(SPACE), p.lstrip(SPACE)[1:]):
            if family[a] is not family[b]:
                family[a] |= family[b]
                for c in family[b]:
                    family[c] = family[a]
    families = {id(f): f for f in family.values()}.values()
    runs = "|".join(f"[{''.join(map(re.escape, sorted(f)))}]+" for f in sorted(families, key=len, reverse=True))
    return (f"{SPACE}*(?:{runs})|" if runs else "") + f"{SPACE}+|(?s:.)"


class Segments(dict):
    """Segment -> its packed ids, found when first asked for.

    No merge crosses the border of a segment, so each is merged by itself.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.older: dict[str, bytes] = {}
        self.ids = {p: i for i, (p, kind) in enumerate(zip(model.pieces, model.kinds)) if kind == NORMAL}
        self.rank = _ranks({p: model.scores[i] for p, i in self.ids.items()})
        self.words = [_packed([i]) for i in range(len(model.pieces))]
        self.bytes = {int(p[1:-1], 16): i for i, (p, kind) in enumerate(zip(model.pieces, model.kinds)) if kind == BYTE}
        self.find = re.compile(_segment_pattern([p for p in self.ids if len(p) > 1])).findall

    def __missing__(self, segment: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        found = self.older.get(segment)
        if found is None:
            found = b"".join(map(self.packed, self.merge(segment)))
        self[segment] = found
        return found

    def packed(self, symbol: str) -> bytes:
        i = self.ids.get(symbol)
        if i is not None:
            return self.words[i]
        if self.model.byte_fallback:
            return b"".join([self.words[self.bytes[b]] for b in symbol.encode()])
        return self.words[self.model.unknown]

    def merge(self, segment: str) -> list[str]:
        """The agenda holds every adjacent pair that is a piece; the best score is merged first, ties from the left.

        An entry is rank and place in one number.  It is out of date if its symbols have no pair of
        that rank any more; a pair that took its place has the same rank and place, so its turn is now.
        """
        rank_of, n = self.rank.get, len(segment)
        if n < 2:
            return [segment]
        symbols = list(segment)
        after, before = (AFTER[:n], BEFORE[:n]) if n <= SHORT else (list(range(1, n + 1)), list(range(-1, n - 1)))
        bits = n.bit_length()
        place, agenda = (1 << bits) - 1, []
        for i in range(n - 1):
            rank = rank_of(segment[i:i + 2])
            if rank is not None:
                agenda.append(rank << bits | i)
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            i = entry & place
            j = after[i]
            left = symbols[i]
            if j >= n or not left:
                continue
            merged = left + symbols[j]
            if rank_of(merged) != entry >> bits:
                continue
            symbols[i], symbols[j] = merged, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rank_of(merged + symbols[k])
                if rank is not None:
                    heappush(agenda, rank << bits | i)
            h = before[i]
            if h >= 0:
                rank = rank_of(symbols[h] + merged)
                if rank is not None:
                    heappush(agenda, rank << bits | h)
        return [s for s in symbols if s]


class Codec:
    """One worker's encoder and decoder, kept from task to task."""

    held: "Codec | None" = None

    def __init__(self, model: PieceModel):
        self.model, self.segments = model, Segments(model)
        self.begin, self.end = _packed([model.begin]), _packed([model.end])
        self.surface = [self._surface(p, kind) for p, kind in zip(model.pieces, model.kinds)]
        self.control = np.array([kind == CONTROL for kind in model.kinds])
        self.library = None

    def _surface(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        return {CONTROL: "", UNKNOWN: self.model.unknown_text}.get(kind, piece.replace(SPACE, " ")).encode()

    @classmethod
    def of(cls, model: PieceModel) -> "Codec":
        if cls.held is None or cls.held.model.file != model.file:
            cls.held = cls(model)
        return cls.held

    def encode(self, text: str) -> bytes:
        if not text:
            return self.begin + self.end
        escaped = (SPACE if self.model.prefix else "") + text.replace(" ", SPACE)
        body = b"".join(map(self.segments.__getitem__, self.segments.find(escaped)))
        if not self.model.byte_fallback:  # neighbouring unknown characters are one token
            ids = np.frombuffer(body, "<u4")
            same = (ids[1:] == self.model.unknown) & (ids[:-1] == self.model.unknown)
            body = ids[np.concatenate([[True], ~same])].tobytes()
        return self.begin + body + self.end

    def by_library(self, texts: list[str]) -> list[bytes]:
        if self.library is None:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=self.model.file)
        return [_packed(ids) for ids in self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)]

    def decode(self, packed: bytes) -> str:
        """As the library decodes: the space that stands before a text goes, control pieces have no text."""
        ids = np.frombuffer(packed, "<u4")
        if len(ids) and ids.max() >= len(self.surface):
            raise ValueError("ids beyond the vocabulary")
        if len(ids) and ids[0] == self.model.begin:
            ids = ids[1:]
        if len(ids) and ids[-1] == self.model.end:
            ids = ids[:-1]
        kinds, body = self.model.kinds, ids.tolist()
        raw = b"".join(map(self.surface.__getitem__, body))
        if body and self.model.prefix and kinds[body[0]] == NORMAL and self.model.pieces[body[0]].startswith(SPACE):
            raw = raw[1:]
        if not self.control[ids].any():
            try:
                return raw.decode()
            except UnicodeDecodeError:
                pass
        # Broken byte runs, or control pieces inside: run by run, every byte outside a whole character by itself.
        text, first, run = "", True, b""
        for i in [*body, None]:
            if i is not None and kinds[i] == BYTE:
                run += self.surface[i]
                continue
            text, run = text + _characters(run), b""
            if i is not None:
                piece = self.surface[i].decode()
                if first and not text and kinds[i] == NORMAL and self.model.prefix and self.model.pieces[i].startswith(SPACE):
                    piece, first = piece[1:], False
                text += piece
        return text


def _characters(run: bytes) -> str:
    """Whole UTF-8 characters as they are, every other byte as the replacement character."""
    out, at = "", 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out += run[at:at + size].decode()
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out, at = out + "�", at + 1
    return out


def _mapped(rows: DataFrame, model: PieceModel, fields: list[T.StructField], work) -> DataFrame:
    """Adds ``fields`` to the two columns of ``rows``: ``work(codec, values)`` per slice of an Arrow batch."""
    schema = T.StructType([*rows.schema.fields, *fields])
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(shared.value)
        for b in batches:
            values = b.column(1)
            part, size = [], 0
            for i, v in enumerate(values, 1):
                part.append(v.as_py())
                size += len(part[-1] or "")
                if size >= CHUNK or i == len(values):
                    here = b.slice(i - len(part), len(part))
                    added = work(codec, part)
                    yield pa.RecordBatch.from_arrays([*here.columns, *added], names=schema.names)
                    part, size = [], 0

    return rows.mapInArrow(run, schema)


def _encoded(codec: Codec, texts: list[str | None], check: bool) -> list[pa.Array]:
    texts = [t or "" for t in texts]
    ids = [codec.encode(t) for t in texts]
    agrees = [a == b for a, b in zip(ids, codec.by_library(texts))] if check else [None] * len(ids)
    return [pa.array(ids, pa.binary()), pa.array(agrees, pa.bool_())]


IDS, AGREES, DECODED = (
    T.StructField("ids", T.BinaryType()), T.StructField("agrees", T.BooleanType()), T.StructField("decoded", T.StringType()))


def encode_pieces(entities: DataFrame, model: PieceModel, check: bool = True) -> DataFrame:
    """Token ids of every whole text, with begin and end ids and without sampling.

    ``entities`` has ``entity_id`` and ``text``; other columns are ignored, null and empty texts have
    only the begin and the end id.  Returns entity_id, text, ids and agrees per input row (repeated
    rows and null ids are rows like others).  ``ids`` are packed as unsigned 32-bit little-endian
    numbers, the form in which token shards are stored; ``unpacked`` makes an array of them.  Names of
    control and byte pieces in a text are ordinary text.  With ``check``, ``agrees`` tells whether the
    sentencepiece library gives the same ids for the text, else it is null.

    The agenda works on the segments of a text that no merge can cross; a worker remembers those it
    has met, so its memory is that of REMEMBERED segments and of CHUNK characters of text.
    """
    return _mapped(entities.select("entity_id", "text"), model, [IDS, AGREES], lambda c, texts: _encoded(c, texts, check))


def decode_pieces(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """entity_id, ids (packed) and the text ``decoded`` from them; null ids give null, unknown ids are an error."""
    def work(codec: Codec, ids: list[bytes | None]) -> list[pa.Array]:
        return [pa.array([None if i is None else codec.decode(i) for i in ids], pa.string())]

    return _mapped(encoded.select("entity_id", "ids"), model, [DECODED], work)


def round_trip(entities: DataFrame, model: PieceModel, check: bool = True) -> DataFrame:
    """``encode_pieces`` and ``decode_pieces`` in one pass over the texts: entity_id, ids, agrees, decoded."""
    def work(codec: Codec, texts: list[str | None]) -> list[pa.Array]:
        ids, agrees = _encoded(codec, texts, check)
        return [ids, agrees, pa.array([codec.decode(i.as_py()) for i in ids], pa.string())]

    return _mapped(entities.select("entity_id", "text"), model, [IDS, AGREES, DECODED], work).drop("text")


def unpacked(ids: Column) -> Column:
    """Packed ids as array<bigint>."""
    one = r"([0-9A-F]{2})([0-9A-F]{2})([0-9A-F]{2})([0-9A-F]{2})"
    words = F.filter(F.split(F.regexp_replace(F.hex(ids), one, "$4$3$2$1 "), " "), lambda w: w != "")
    return F.transform(words, lambda w: F.conv(w, 16, 10).cast("bigint"))
