"""Document quality by attention-based multiple-instance learning.

A document is a bag of equal passages of about 512 bytes.  Each passage is encoded (byte-class pair
frequencies and repetition, then one learned tanh layer); gated attention
``a = softmax(w . (tanh(V h) * sigmoid(U h)))`` weighs the passages and a logistic unit scores the
weighted mean.  All parameters are learned together from document labels alone.

Fitting takes at most ``train_docs`` labelled documents, those with the smallest hash of their doc_id,
and of these, in that order, no more than have ``train_bytes`` bytes of text (but the first of each class):
the bounds keep the driver's share constant, about two bytes for each byte of text.  Scoring reads every whole text in one
scan without a shuffle; the model is some 10,000 numbers.
Null and empty texts are one passage of zeros and get a score too; texts of any length are whole.
Repeated rows are scored alike; an empty table gives no rows.  Duplicate labels: the smallest counts.  If labels of one class only (or none) can be learned from, all documents get its share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, arrow_map

PASSAGE = 512
BLOCK = 1 << 18
CLASSES = 16
WIDTH = CLASSES * CLASSES + 6


def byte_classes() -> np.ndarray:
    """The class of each byte."""
    table = np.full(256, 15, dtype=np.uint8)
    groups = [range(97, 123), range(65, 91), range(48, 58), b" ", b"\t\n\r\x0b\x0c", b".", b",", b"!?", b"'\"`", b"|", b"*$%&#@", b"^~_=+<>/\\", b"()[]{}", b";:-", range(192, 256)]
    for k, members in enumerate(groups):
        table[list(members)] = k
    return table


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, first passage of each row) of a text column.

    Bytes are counted a block at a time, so that beside the features only a few bytes are held for each byte of text.
    """
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    per_doc = np.maximum(1, (lengths + PASSAGE // 2) // PASSAGE)  # of equal size: a tail of a few bytes would be like no other
    first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
    count = int(per_doc.sum())
    out = np.zeros((count, WIDTH), dtype=np.float32)
    if not len(data):
        return out, first
    begin = offsets[:-1] - offsets[0]
    kind = byte_classes()[data]
    pairs, size, breaks = out[:, : CLASSES * CLASSES], np.zeros(count, np.int64), np.zeros(count, np.int64)

    def owners(at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return first[doc] + (at - begin[doc]) * per_doc[doc] // lengths[doc]

    for i in range(0, len(data), BLOCK):
        j = min(i + BLOCK, len(data))
        low, high = np.searchsorted(begin, [i, j - 1], side="right") - 1
        inside = np.arange(low, high + 1)
        doc = np.repeat(inside, np.minimum(begin[inside] + lengths[inside], j) - np.maximum(begin[inside], i))
        at = np.arange(i, j)
        place = owners(at, doc)
        base, n = int(place[0]), int(place[-1] - place[0]) + 1
        size[base : base + n] += np.bincount(place - base, minlength=n)
        breaks[base : base + n] += np.bincount(place[data[i:j] == 10] - base, minlength=n)
        second = at > begin[doc]
        at, place = at[second], place[second] - base
        pair = place * (CLASSES * CLASSES) + kind[at - 1].astype(np.int64) * CLASSES + kind[at]
        pairs[base : base + n] += np.bincount(pair, minlength=n * CLASSES * CLASSES).reshape(n, -1)
    np.divide(pairs, np.maximum(1, size).astype(np.float32)[:, None], out=pairs)
    np.sqrt(pairs, out=pairs)
    blank = (kind == 3) | (kind == 4)
    start = ~blank
    opens = np.zeros(len(data), dtype=bool)
    opens[begin[lengths > 0]] = True
    start[1:] &= blank[:-1] | opens[1:]
    words = np.flatnonzero(start)
    doc = np.searchsorted(begin, words, side="right") - 1
    place = owners(words, doc)
    n_words = np.bincount(place, minlength=count)
    # 16 bytes from each word on, as a hash: repeated within the passage, and anywhere in the document
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    wide = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 16)[words]).view(np.uint64).reshape(-1, 2)
    h = wide[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ (wide[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))
    for slot, owner in ((1, place), (2, doc)):
        key = (h >> np.uint64(20) << np.uint64(20)) ^ owner.astype(np.uint64)
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        out[:, -slot] = np.bincount(place[times[inverse] > 1], minlength=count) / np.maximum(1, n_words)
    out[:, -3] = np.log1p(size / np.maximum(1, n_words))
    out[:, -4] = np.log1p(n_words) / 5
    out[:, -5] = np.log1p(lengths[np.repeat(np.arange(len(lengths)), per_doc)]) / 10
    out[:, -6] = breaks / np.maximum(1, size)
    return out, first


class GatedAttention:
    """The network, with its gradient written out; parameters in one dict of arrays."""

    def __init__(self, hidden: int = 32, gate: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.shift, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.p = {
            "W": rng.normal(0, WIDTH**-0.5, (WIDTH, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gate)), "U": rng.normal(0, hidden**-0.5, (hidden, gate)),
            "w": rng.normal(0, gate**-0.5, gate), "o": rng.normal(0, hidden**-0.5, hidden), "c": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        p = self.p
        x = np.clip((x - self.shift) / self.scale, -5, 5)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        y = 1 / (1 + np.exp(-(z @ p["o"] + p["c"])))
        return x, h, t, s, a, z, y, bag

    def gradient(self, x: np.ndarray, first: np.ndarray, target: np.ndarray) -> dict:
        p = self.p
        x, h, t, s, a, z, y, bag = self.forward(x, first)
        d = ((y - target) / len(target)).astype(np.float32)
        dz = d[:, None] * p["o"]
        dh = a[:, None] * dz[bag]
        da = (h * dz[bag]).sum(1)
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        dg = de[:, None] * p["w"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh += dt @ p["V"].T + ds @ p["U"].T
        dx = dh * (1 - h * h)
        return {"W": x.T @ dx, "b": dx.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "o": z.T @ d, "c": d.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], target: np.ndarray, epochs: int = 25, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, steps: int = 300, seed: int = 7) -> None:
        """Adam over shuffled batches of bags, for as many epochs as ``steps`` steps take if that is more."""
        epochs = max(epochs, -(-steps // -(-len(bags) // batch)))
        everything = np.concatenate(bags)
        spread = everything.std(0)
        # what never varied here has nothing learned about it, so it must not move a score later
        self.shift, self.scale = everything.mean(0), np.where(spread < 1e-3, np.float32(1e6), spread + np.float32(0.02))
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), batch):
                chosen = order[i : i + batch]
                sizes = [len(bags[k]) for k in chosen]
                g = self.gradient(np.concatenate([bags[k] for k in chosen]), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), target[chosen])
                step += 1
                for k in self.p:
                    g[k] = g[k] + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= (rate * (1 - 0.9 * epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)[6]


class Constant:
    """Stands in where there is nothing to tell apart."""

    def __init__(self, share: float):
        self.share = share

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.full(len(first), self.share)


def train(docs: DataFrame, labels: DataFrame, train_docs: int = 6000, train_bytes: int = 48_000_000, slice_bytes: int = 1_000_000) -> GatedAttention | Constant:
    """Fits on at most ``train_docs`` rows of ``docs(doc_id, text)`` with a label in ``labels(doc_id, quality)``, of ``train_bytes`` bytes at most."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("__y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    store = Stored(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in slices(batches, slice_bytes):
            x, first = passages(part.column("text"))
            ends = np.append(first[1:], len(x))
            yield {"doc_id": part.column("doc_id"), "y": part.column("__y"), "x": [x[i:j].tobytes() for i, j in zip(first, ends)]}

    rows = rows.select(F.col("doc_id").cast("long"), F.col("__y").cast("double"), F.col("text").cast("string"))
    encoded = store.put(arrow_map(rows, run, "doc_id long, y double, x binary"))
    # windows over train_docs documents at most (rows, where ids repeat)
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    sizes = encoded.select("doc_id", "y", (F.octet_length("x") * (PASSAGE / (4 * WIDTH))).alias("size")).groupBy("doc_id", "y").agg(F.sum("size").alias("size"))
    sizes = sizes.select("doc_id", F.sum("size").over(order).alias("total"), F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")).alias("place"))
    fitting = sizes.where((F.col("total") <= train_bytes) | (F.col("place") == 1)).select("doc_id")
    got = encoded.join(F.broadcast(fitting), "doc_id", "left_semi").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    store.drop(encoded)
    target = got.column("y").to_numpy().astype(np.float32)
    if not len(target) or target.min() == target.max():
        return Constant(float(target.mean()) if len(target) else 0.5)
    model = GatedAttention()
    model.fit([np.frombuffer(x, np.float32).reshape(-1, WIDTH) for x in got.column("x").to_pylist()], target)
    return model


def slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``size`` bytes of text."""
    for batch in batches:
        step = max(1, int(size / max(1.0, batch.column("text").nbytes / max(1, batch.num_rows))))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def predict(docs: DataFrame, model: GatedAttention | Constant, slice_bytes: int = 1_000_000) -> DataFrame:
    """``docs(doc_id, text, held_out)`` → doc_id, held_out, score; about ``slice_bytes`` of text are encoded at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in slices(batches, slice_bytes):
            scores = model.score(*passages(part.column("text")))
            yield {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": scores.astype(np.float64)}

    rows = docs.select(F.col("doc_id").cast("long"), F.col("held_out").cast("boolean"), F.col("text").cast("string"))
    return arrow_map(rows, run, "doc_id long, held_out boolean, score double")


def accepted(docs: DataFrame, model: GatedAttention | Constant, threshold: float = 0.3, slice_bytes: int = 1_000_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, slice_bytes):
            yield part.filter(pa.array(model.score(*passages(part.column("text"))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
