"""Text quality: attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

PASSAGE_WORDS = 64
CHUNK = 1_000_000  # bytes of text encoded at once
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Classes of bytes: blanks, small letters, capitals, digits, beyond ASCII, control, each punctuation mark.
_CLASS = np.full(256, 5, np.int64)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
for _i, _c in enumerate(PUNCTUATION):
    _CLASS[ord(_c)] = 6 + _i
_CLASSES = 6 + len(PUNCTUATION)
FEATURES = _CLASSES + 4
_POWERS = np.cumprod(np.full(4096, 1099511628211, np.uint64), dtype=np.uint64)


def encode_passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages (PASSAGE_WORDS words each) of all texts, and each text's number of passages.

    A passage has the root shares of the byte classes, its words repeated at once, its mean word
    length, its size, and the words that end in a mark.  A text without words is one empty passage.
    """
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])[:-1].astype(np.int64)
    kind = _CLASS[data]
    blank = kind == 0
    head = ~blank & np.concatenate([[True], blank[:-1]])
    first = np.flatnonzero(head)  # of each word
    last = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]]))
    owner = np.searchsorted(starts, first, "right") - 1
    words = np.bincount(owner, minlength=len(texts))
    passages = np.maximum(1, -(-words // PASSAGE_WORDS))
    base = np.cumsum(passages) - passages
    order = np.arange(len(first)) - (np.cumsum(words) - words)[owner]
    of_word = base[owner] + order // PASSAGE_WORDS
    total = int(passages.sum())
    # A passage begins at its first word, the first one of a text at the text.
    begin = np.zeros(len(data) + 1, np.int32)
    np.add.at(begin, first[(order % PASSAGE_WORDS == 0) & (order > 0)], 1)
    np.add.at(begin, starts, 1)
    of_byte = np.cumsum(begin[:-1]) - 1
    shares = np.bincount(of_byte * _CLASSES + kind, minlength=total * _CLASSES).reshape(total, _CLASSES).astype(np.float64)
    shares /= np.maximum(1, shares.sum(axis=1, keepdims=True))
    out = np.zeros((total, FEATURES), np.float32)
    out[:, :_CLASSES] = np.sqrt(shares)
    if len(first):
        length = last - first + 1
        small = data + np.where(kind == 2, 32, 0).astype(np.uint8)
        from_head = np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(data)]])))
        place = np.arange(len(data)) - from_head
        weighed = np.where(blank, np.uint64(0), (small.astype(np.uint64) + 1) * _POWERS[place % 4096])
        code = np.add.reduceat(weighed, first)
        again = np.zeros(len(first))
        again[1:] = (code[1:] == code[:-1]) & (length[1:] == length[:-1]) & (owner[1:] == owner[:-1])
        n = np.maximum(1, np.bincount(of_word, minlength=total))
        out[:, _CLASSES] = np.bincount(of_word, again, total) / n
        out[:, _CLASSES + 1] = np.log1p(np.bincount(of_word, length, total) / n)
        out[:, _CLASSES + 2] = np.log1p(np.bincount(of_word, minlength=total))
        out[:, _CLASSES + 3] = np.bincount(of_word, kind[last] >= 6, total) / n
    return out, passages


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class AttentionModel:
    """Gated attention over encoded passages; ``weights`` is None for a constant score."""

    prior: float
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] | None = None

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -6, 6)

    @staticmethod
    def forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, bag: np.ndarray):
        e = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(e @ w["V"]), _sigmoid(e @ w["U"])
        g = (t * s) @ w["a"]
        ex = np.exp(g - np.maximum.reduceat(g, starts)[bag])
        a = ex / np.add.reduceat(ex, starts)[bag]
        z = np.add.reduceat(a[:, None] * e, starts)
        return e, t, s, a, z, _sigmoid(z @ w["c"] + w["d"])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        x, passages = encode_passages(texts)
        starts = np.cumsum(passages) - passages
        bag = np.repeat(np.arange(len(texts)), passages)
        return self.forward(self.weights, self.standard(x), starts, bag)[-1]


def fit_bags(x: np.ndarray, passages: np.ndarray, y: np.ndarray, hidden: int = 16, gates: int = 8,
             rounds: int = 400, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Full-batch Adam on the cross entropy of the bags' labels."""
    prior = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return AttentionModel(prior)
    rng = np.random.default_rng(seed)
    model = AttentionModel(prior, x.mean(axis=0), x.std(axis=0) + 0.02)
    x = model.standard(x).astype(np.float64)
    starts, bag = np.cumsum(passages) - passages, np.repeat(np.arange(len(y)), passages)
    shape = {"W": (x.shape[1], hidden), "b": (hidden,), "V": (hidden, gates), "U": (hidden, gates), "a": (gates,), "c": (hidden,), "d": (1,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s) for k, s in shape.items()}
    mean, square = ({k: np.zeros(s) for k, s in shape.items()} for _ in range(2))
    for r in range(1, rounds + 1):
        e, t, s, a, z, p = model.forward(w, x, starts, bag)
        out = (p - y) / len(y)
        dz = out[:, None] * w["c"]
        da = (dz[bag] * e).sum(axis=1)
        dg = a * (da - np.add.reduceat(a * da, starts)[bag])
        dt, ds = dg[:, None] * w["a"] * s * (1 - t * t), dg[:, None] * w["a"] * t * s * (1 - s)
        de = (a[:, None] * dz[bag] + dt @ w["V"].T + ds @ w["U"].T) * (1 - e * e)
        grad = {"W": x.T @ de, "b": de.sum(axis=0), "V": e.T @ dt, "U": e.T @ ds, "a": (t * s).T @ dg,
                "c": z.T @ out, "d": out.sum(keepdims=True)}
        for k, g in grad.items():
            g = g + decay * w[k]
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            w[k] = w[k] - rate * (mean[k] / (1 - 0.9**r)) / (np.sqrt(square[k] / (1 - 0.999**r)) + 1e-8)
    model.weights = w
    return model


def fit_quality(entities: DataFrame, labels: DataFrame, fit_rows: int = 6000) -> AttentionModel:
    """Learn from ``labels`` (entity_id, quality 0/1; null labels are ignored) of ``entities`` (entity_id, text).

    ``fit_rows`` bounds the labelled rows that are used: those with the smallest md5 of their id, the
    same ones on any partitioning.  Rows that share an id count once.  Without labels, or with
    labels of one kind only, the model is the constant share of label 1 (0.5 without any).
    """
    rank = F.md5(F.col("entity_id").cast("string"))
    taken = (
        labels.filter(F.col("quality").isNotNull() & F.col("entity_id").isNotNull())
        .groupBy("entity_id").agg(F.min("quality").alias("quality")).orderBy(rank).limit(fit_rows)
    )
    # At most fit_rows ids: small enough to send to every task.
    texts = entities.select("entity_id", "text").join(F.broadcast(taken), "entity_id").groupBy("entity_id").agg(
        F.min("text").alias("text"), F.min("quality").alias("quality"))
    schema = "entity_id string, quality int, passages int, features array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n = encode_passages(b.column(1).to_pylist())
            ends = np.concatenate([[0], np.cumsum(n)]) * FEATURES
            features = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int32()), features],
                                             ["entity_id", "quality", "passages", "features"])

    rows = texts.select(F.col("entity_id").cast("string"), "text", F.col("quality").cast("int")).mapInArrow(run, schema).toArrow()
    rows = rows.sort_by("entity_id")
    x = np.asarray(rows["features"].combine_chunks().flatten(), np.float64).reshape(-1, FEATURES)
    return fit_bags(x, np.asarray(rows["passages"], np.int64), np.asarray(rows["quality"], np.float64))


def score_quality(entities: DataFrame, model: AttentionModel) -> DataFrame:
    """All columns of ``entities`` and ``quality``: the model's probability of label 1 (double, never null).

    Only ``text`` is read; null and empty texts score as one empty passage.  An input column
    called ``quality`` is replaced.
    """
    rows = entities.drop("quality")
    schema = T.StructType([*rows.schema.fields, T.StructField("quality", T.DoubleType())])
    at = rows.columns.index("text")
    shared = entities.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, scores, lo = b.column(at), [], 0
            while lo < len(texts):
                part, size = [], 0
                while lo < len(texts) and (not part or size < CHUNK):
                    part.append(texts[lo].as_py())
                    size += len(part[-1] or "")
                    lo += 1
                scores.append(shared.value.score(part))
            scores = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, "quality"])

    return rows.mapInArrow(run, schema)
