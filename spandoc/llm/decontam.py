"""Benchmark decontamination: a generalised suffix automaton of the test items, entities streamed through it."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from spandoc.llm.common import Space

# Every byte that is neither an ASCII letter or digit nor part of a multi-byte character ends a word.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over words, with the items of every window.

    A window is ``window`` consecutive words of an item, or the whole item if it is shorter.
    ``items_at`` has, per state and window length, the items with that window.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        # (state, window length) -> items; a state stands for several lengths, a window has one.
        found: dict[tuple[int, int], set[str]] = {}
        for name, words in items:
            size = min(window, len(words))
            state = matched = 0
            for w in words:
                state, matched = self.step(state, matched, w)
                if matched > size:
                    matched = size
                while self.length[self.link[state]] >= matched and state:
                    state = self.link[state]
                if matched == size:
                    found.setdefault((state, size), set()).add(name)
        self.items_at: list[list[tuple[int, tuple[str, ...]]]] = [[] for _ in self.next]
        for (state, size), names in found.items():
            self.items_at[state].append((size, tuple(sorted(names))))
        # Nearest state on the chain of suffix links, itself included, that has windows.
        self.marked = [-1] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.marked[s] = s if self.items_at[s] else self.marked[self.link[s]] if s else -1

    def _extend(self, last: int, w: bytes) -> int:
        old = self.next[last].get(w)
        if old is not None and self.length[old] == self.length[last] + 1:
            return old
        if old is not None:
            return self._clone(last, w, old)
        cur = self._state({}, -1, self.length[last] + 1)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
        else:
            q = self.next[p][w]
            self.link[cur] = q if self.length[p] + 1 == self.length[q] else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _state(self, following: dict[bytes, int], link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def step(self, state: int, matched: int, w: bytes) -> tuple[int, int]:
        """The longest suffix of what was read, ``w`` included, that occurs in an item: its state and length."""
        following = self.next
        while state and w not in following[state]:
            state = self.link[state]
            matched = self.length[state]
        to = following[state].get(w)
        return (0, 0) if to is None else (to, matched + 1)

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged spans [start, end) of words inside a window, and the items whose windows occur."""
        spans: list[list[int]] = []
        items: set[str] = set()
        state = matched = 0
        following, marked, link = self.next, self.marked, self.link
        root = following[0]
        for i, w in enumerate(words):
            if not state:
                state = root.get(w, 0)
                matched = 1 if state else 0
            else:
                state, matched = self.step(state, matched, w)
            s = marked[state]
            longest = 0
            while s > 0:
                for size, names in self.items_at[s]:
                    if size <= matched:
                        items.update(names)
                        longest = max(longest, size)
                s = marked[link[s]]
            if longest:
                start = i + 1 - longest
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return spans, items


def _cut(text: str, spans: list[list[int]]) -> str:
    """``text`` without the characters from the first to the last word of each span."""
    raw = text.encode()
    table, at, inside = raw.translate(_WORD_BYTES), [], False
    for i, b in enumerate(table):
        if (b != 32) != inside:
            at.append(i)
            inside = not inside
    at += [len(raw)] * (len(at) % 2)
    keep, done = [], 0
    for start, end in spans:
        keep.append(raw[done:at[2 * start]])
        done = at[2 * end - 1]
    return b"".join([*keep, raw[done:]]).decode()


def _item_groups(items: DataFrame, max_words: int) -> list[list[tuple[str, list[bytes]]]]:
    """Items in groups of at most ``max_words`` words (one longer item alone), read one after another."""
    groups: list[list[tuple[str, list[bytes]]]] = [[]]
    room = max_words
    for r in items.select(F.col("item_id").cast("string").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        words = item_words(r.text)
        if not words:
            continue
        if len(words) > room and groups[-1]:
            groups.append([])
            room = max_words
        groups[-1].append((r.item_id or "", words))
        room -= len(words)
    return groups


def contamination(
    entities: DataFrame, items: DataFrame, window: int = 13, one_in: int = 20, max_words: int = 2_000_000,
    with_text: bool = True, keep: bool = False,
) -> DataFrame:
    """Words of every entity that lie in a window of a benchmark item.

    ``entities`` has ``entity_id`` and ``text``, ``items`` has ``item_id`` and ``text``; other columns are
    ignored, unless ``keep`` asks for those of ``entities`` (those with a name of a result column are replaced).  Words are runs of ASCII letters (lower-cased) and digits and of all characters beyond
    ASCII.  The items become a suffix automaton that is sent to every task; ``max_words`` bounds
    the words of one automaton, more items are scanned in rounds of one automaton each and the rounds'
    spans are merged.  The entities are read as a stream, one at a time.

    Returns one row per input row: entity_id, n_words, n_hit, n_items, items_sha256, contaminated (at least
    one word, and at least one in ``one_in``, was hit), and with ``with_text`` clean_text: the text without
    the hit spans if contaminated, otherwise as it is.  Null texts have no words and stay null; null item
    ids count as an item named ''; items without words match nothing; repeated rows are judged row by row.
    """
    spark = entities.sparkSession
    rows = entities.select(
        F.struct(*entities.columns if keep else ["entity_id"]).alias("row"), "text",
        F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("array<array<int>>").alias("spans"))
    groups = _item_groups(items, max_words)
    space = Space(spark) if len(groups) > 1 else None
    for group in groups[:-1]:
        rows = space.write(rows.mapInArrow(_round(spark.sparkContext.broadcast(Automaton(group, window))), rows.schema))
    fields = [
        rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType())]
    fields += [T.StructField("clean_text", T.StringType())] * with_text
    last = _verdict(spark.sparkContext.broadcast(Automaton(groups[-1], window)), one_in, with_text)
    judged = rows.mapInArrow(last, T.StructType(fields))
    results = judged.columns[1:]
    own = [c for c in entities.columns if c not in results] if keep else ["entity_id"]
    return judged.select(*[F.col("row").getField(c).alias(c) for c in own], *results)


def _round(shared):
    """Scan with one of several automata; its findings join those of earlier rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for b in batches:
            items, spans = [], []
            for text, names, had in zip(b.column(1), b.column(2), b.column(3)):
                new, found = automaton.scan(item_words(text.as_py()))
                items.append([*(names.as_py() or ()), *sorted(found)] or None)
                spans.append([*(had.as_py() or ()), *new] or None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(items, pa.list_(pa.string())),
                 pa.array(spans, pa.list_(pa.list_(pa.int32())))], ["row", "text", "items", "spans"])

    return run


def _union(spans: list[list[int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for a, z in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], z)
        else:
            merged.append([a, z])
    return merged


def _verdict(shared, one_in: int, with_text: bool):
    """Scan with the last automaton and judge."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
    names = ["row", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "clean_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for b in batches:
            rows = []
            for text, items, had in zip(b.column(1), b.column(2), b.column(3)):
                text = text.as_py()
                words = item_words(text)
                spans, found = automaton.scan(words)
                spans = _union(spans + (had.as_py() or []))
                found = sorted(found.union(items.as_py() or ()))
                hit = sum(z - a for a, z in spans)
                bad = hit > 0 and one_in * hit >= len(words)
                rows.append((len(words), hit, len(found), sha256(",".join(found).encode()).hexdigest(), bad,
                             _cut(text, spans) if bad and with_text else text))
            cols = list(zip(*rows)) if rows else [()] * 6
            use = 6 if with_text else 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(cols[:use], kinds))], names[:use + 1])

    return run
