"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes.  Each passage is described by
its character-class pairs, word lengths and repeated words, and encoded by one
hidden layer.  Gated attention gives every passage a weight, the score is a logistic
function of the weighted passage representation.  Encoder, attention and classifier
are learned together from labels of whole documents.

The model is fitted on the driver from at most ``max_labelled`` labelled documents
(those with the smallest digest of their id); scoring runs over whole texts of all
documents, batch by batch.

Rules for unusual rows: a null or empty text is one empty passage and gets a score;
rows without a label or with a null id are scored but not learned from; repeated
rows get equal scores; with labels of one kind or none the score is the smoothed
share of label 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.bytesets import U64, Prefix, byte_values, chunks, mixed
from tidepanel.llm.common import text_of

PASSAGE = 512
MAX_LABELLED = 4000
CLASSES = 16
LETTERS = byte_values(5)
PREFIX = Prefix()


def byte_classes() -> np.ndarray:
    """A class for each byte: letters by case, digits, blanks, groups of signs, beyond ASCII."""
    out = np.full(256, 14, np.uint8)
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r",
              ".", ",", "!?", "|", "#", "*", "&%$@~^+", "\"'()[]{}<>", "-_=/\\:;"]
    for i, group in enumerate(groups):
        out[[ord(c) for c in group]] = i
    out[128:] = 15
    return out


CLASS = byte_classes()
WIDTH = CLASSES * CLASSES + CLASSES + 4


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the texts in turn, and the number of passages of each text."""
    size = np.array([len(x) for x in texts], np.int64)
    count = np.maximum(-(-size // PASSAGE), 1)
    total = int(count.sum())
    first = np.cumsum(count) - count
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(texts)), size)
    passage = first[owner] + (np.arange(len(data)) - begin[owner]) // PASSAGE
    kind = CLASS[data]
    one = np.bincount(passage * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES)
    inside = np.flatnonzero(passage[1:] == passage[:-1]) if len(data) > 1 else np.zeros(0, np.int64)
    pair = kind[inside].astype(np.int64) * CLASSES + kind[inside + 1]
    width = CLASSES * CLASSES
    two = np.bincount(passage[inside] * width + pair, minlength=total * width).reshape(total, width)
    blank = np.isin(kind, (3, 4))
    edge = np.flatnonzero(np.diff(~blank, prepend=False, append=False) | _splits(passage, blank))
    start = edge[:-1][~blank[edge[:-1]]] if len(edge) else edge
    end = edge[1:][~blank[edge[:-1]]] if len(edge) else edge
    words = np.bincount(passage[start], minlength=total) if len(start) else np.zeros(total, int)
    sums = PREFIX.sums(data, LETTERS)
    digest = mixed(PREFIX.ranges(sums, start, end)) ^ mixed(passage[start].astype(U64)) if len(start) else start
    _, at = np.unique(digest, return_index=True)
    distinct = np.bincount(passage[start[at]], minlength=total) if len(start) else words
    bytes_of = np.maximum(one.sum(axis=1), 1)[:, None]
    length = np.bincount(passage[start], weights=end - start, minlength=total) if len(start) else words
    rest = np.stack(
        [
            length / np.maximum(words, 1) / 10,
            distinct / np.maximum(words, 1),
            np.log1p(one.sum(axis=1)) / 7,
            np.log1p(np.repeat(size, count)) / 10,
        ],
        axis=1,
    )
    return np.hstack([np.sqrt(one / bytes_of), np.sqrt(two / bytes_of), rest]).astype(np.float32), count


def _splits(passage: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Where a word goes on in the next passage: it is cut there."""
    out = np.zeros(len(passage) + 1, bool)
    if len(passage) > 1:
        out[1:-1] = (passage[1:] != passage[:-1]) & ~blank[1:] & ~blank[:-1]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """Gated attention over encoded passages."""

    share: float = 0.5
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def start(width: int, hidden: int = 24, gate: int = 12, seed: int = 3) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b)).astype(np.float32)
        return {
            "encode": draw(width, hidden), "encode0": np.zeros(hidden, np.float32),
            "look": draw(hidden, gate), "gate": draw(hidden, gate), "pick": draw(gate, 1),
            "score": draw(hidden, 1), "score0": np.zeros(1, np.float32),
        }

    @staticmethod
    def forward(w, x, count):
        """Scores of the bags, and what the gradient needs."""
        first = np.cumsum(count) - count
        h = np.tanh(x @ w["encode"] + w["encode0"])
        look, gate = np.tanh(h @ w["look"]), sigmoid(h @ w["gate"])
        e = ((look * gate) @ w["pick"])[:, 0]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        a = e / np.repeat(np.add.reduceat(e, first), count)
        z = np.add.reduceat(a[:, None] * h, first)
        return sigmoid((z @ w["score"] + w["score0"])[:, 0]), (first, h, look, gate, a, z)

    @classmethod
    def gradient(cls, w, x, count, y):
        p, (first, h, look, gate, a, z) = cls.forward(w, x, count)
        d = ((p - y) / len(y)).astype(np.float32)[:, None]
        g = {"score": z.T @ d, "score0": d.sum(axis=0)}
        dz = np.repeat(d @ w["score"].T, count, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), count))
        du = de[:, None] @ w["pick"].T
        g["pick"] = (look * gate).T @ de[:, None]
        dlook, dgate = du * gate * (1 - look**2), du * look * gate * (1 - gate)
        g["look"], g["gate"] = h.T @ dlook, h.T @ dgate
        dh = (a[:, None] * dz + dlook @ w["look"].T + dgate @ w["gate"].T) * (1 - h**2)
        g["encode"], g["encode0"] = x.T @ dh, dh.sum(axis=0)
        return g

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(count), self.share)
        z = (x - self.weights["mean"]) / self.weights["scale"]
        return self.forward(self.weights, z, count)[0].astype(np.float64)


def train(
    bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01,
    decay: float = 1e-4, seed: int = 3,
) -> AttentionModel:
    """Adam over shuffled batches of documents."""
    y = np.asarray(labels, np.float32)
    model = AttentionModel(float((y.sum() + 1) / (len(y) + 2)))
    if len(y) == 0 or y.min() == y.max():
        return model
    every = np.concatenate(bags).astype(np.float32)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 0.05
    bags = [((b.astype(np.float32) - mean) / scale) for b in bags]
    del every
    w = AttentionModel.start(len(mean), seed=seed)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    rng, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for low in range(0, len(y), batch):
            pick = order[low : low + batch]
            count = np.array([len(bags[i]) for i in pick])
            g = AttentionModel.gradient(w, np.concatenate([bags[i] for i in pick]), count, y[pick])
            step += 1
            now = rate * min(1.0, 2 * (1 - epoch / epochs))
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] -= now * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * w[k])
    model.weights = w | {"mean": mean, "scale": scale}
    return model


def held_out(key: Column) -> Column:
    """One row in five, by CRC-32 of the id as text."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = MAX_LABELLED,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    skip: Callable[[Column], Column] = held_out,
) -> AttentionModel:
    """Learns from at most ``max_labelled`` labelled rows outside ``skip``, whole texts of each."""
    sample = (
        labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~skip(F.col(key)))
        .select(F.col(key).alias("l_key"), F.col(label).cast("int").alias("y"))
        .orderBy(F.xxhash64(F.lit(51), "l_key"), "l_key", "y")
        .limit(max_labelled)
    )
    rows = docs.join(F.broadcast(sample), F.col(key) == F.col("l_key")).select(
        "l_key", "y", text_of(text).cast("binary").alias("body")
    )

    def encode(batches):
        for batch in batches:
            bodies = batch.column(2).to_pylist()
            for low, high in chunks(bodies):
                x, count = passages(bodies[low:high])
                ends = np.cumsum(count)
                bags = [x[e - c : e].astype(np.float16).tobytes() for e, c in zip(ends, count)]
                yield pa.record_batch(
                    [batch.column(0)[low:high], batch.column(1)[low:high], pa.array(bags, pa.binary())],
                    names=["l_key", "y", "bag"],
                )

    kind = rows.schema["l_key"].dataType.simpleString()
    found = rows.mapInArrow(encode, f"l_key {kind}, y int, bag binary").toArrow()
    order = np.lexsort((np.asarray(found["y"]), np.asarray(found["l_key"])))
    bags = found["bag"].take(pa.array(order)).to_pylist()
    return train(
        [np.frombuffer(b, np.float16).reshape(-1, WIDTH) for b in bags], np.asarray(found["y"])[order]
    )


def score(
    docs: DataFrame, model: AttentionModel, text: str = "text", name: str = "score"
) -> DataFrame:
    """The rows with all their columns and a last one, the score of label 1, under ``name``."""
    rows = docs.withColumn(name, text_of(text).cast("binary"))  # the texts, until scored
    schema = docs.drop(name).schema.add(name, "double")

    def scan(batches):
        for batch in batches:
            at = batch.schema.get_field_index(name)
            bodies = batch.column(at).to_pylist()
            for low, high in chunks(bodies):
                p = model.score(*passages(bodies[low:high]))
                part = batch.slice(low, high - low)
                others = [i for i in range(part.num_columns) if i != at]
                yield pa.record_batch(
                    [*(part.column(i) for i in others), pa.array(p)],
                    names=[*(part.schema.names[i] for i in others), name],
                )

    return rows.mapInArrow(scan, schema)
