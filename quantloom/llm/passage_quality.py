"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes (cut at white space).  Every
passage of a text is encoded as FEATURES numbers and by one hidden layer; gated
attention gives the passages weights that sum to one; the weighted mean goes
through a logistic output.  Only documents have labels: the attention weights
are learned from them.

Learning uses at most SAMPLE labelled rows (those of the smallest hashes of
their doc_id); prediction covers every passage of every text.

Defined results: null and blank texts are one empty passage; a doc_id labelled
twice counts once with its lowest label; null labels and ids are not learned
from; without labels every score is 0.5; repeated rows each return their
result; an empty table gives an empty result.  Only text is an input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PASSAGE, SAMPLE = 1024, 12_000
HIDDEN, GATE, EPOCHS, RATE, BATCH = 24, 12, 12, 5e-3, 64
CLASSES, PAIRS = 14, 64
FEATURES = CLASSES + PAIRS + 6

_CLASS = np.full(256, 13, np.uint8)
for _i, _chars in enumerate((b" ", b"\n", b"\t\x0b\x0c\r", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b".", b",", b"!?", b"|<>", b"#*$%&", b"()[]{}\"'", bytes(range(128, 256)))):
    _CLASS[list(_chars)] = _i
_POWER = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
_VALUE = np.random.default_rng(6).integers(1, 2**63, 256, dtype=np.uint64)


def passages(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each document) of a buffer of texts."""
    docs = len(at) - 1
    buffer = np.insert(raw, at[1:], 10)  # every document ends with a line feed
    at = at + np.arange(docs + 1)
    kind = _CLASS[buffer]
    # Passages end at the first white space after each multiple of PASSAGE.
    doc = np.repeat(np.arange(docs), np.diff(at))
    within = np.arange(len(buffer)) - at[doc]
    space = kind <= 2
    number = within // PASSAGE
    ends = np.flatnonzero(space)
    new = np.concatenate([[0], np.flatnonzero((number[ends][1:] != number[ends][:-1]) | (doc[ends][1:] != doc[ends][:-1])) + 1]) if len(ends) else np.zeros(0, int)
    start = np.where(np.concatenate([[True], doc[ends[new]][1:] != doc[ends[new]][:-1]]), at[doc[ends[new]]], ends[new])
    start = np.unique(start)
    count = np.bincount(doc[start], minlength=docs)
    size = np.diff(np.append(start, len(buffer))).astype(np.float32)
    passage = np.repeat(np.arange(len(start)), size.astype(int))
    x = np.zeros((len(start), FEATURES), np.float32)
    x[:, :CLASSES] = np.bincount(passage * CLASSES + kind, minlength=len(start) * CLASSES).reshape(-1, CLASSES) / size[:, None]
    before = np.concatenate([[1], kind[:-1]]).astype(np.int64)  # a line feed stands before a text
    pair = (before * CLASSES + kind) % PAIRS
    x[:, CLASSES : CLASSES + PAIRS] = np.bincount(passage * PAIRS + pair, minlength=len(start) * PAIRS).reshape(-1, PAIRS) / size[:, None]
    # Words: their number, length, and how many repeat the last one or the one before it.
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if len(begin):
        run = np.arange(len(buffer)) - np.maximum.accumulate(np.where(np.isin(np.arange(len(buffer)), begin), np.arange(len(buffer)), 0))
        h = np.add.reduceat(np.where(space, np.uint64(0), _VALUE[buffer] * _POWER[run & 63]), begin)
        owner = passage[begin]
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])])
        two = np.concatenate([[False] * 2, (h[2:] == h[:-2]) & (owner[2:] == owner[:-2])])[: len(h)]
        fresh = np.unique(owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ h, return_index=True)[1]
        words = np.bincount(owner, minlength=len(start)).astype(np.float32)
        per = np.maximum(words, 1)
        x[:, -6] = np.log1p(words) / 6
        x[:, -5] = np.where(words > 0, np.minimum(size / per / 16, 4), 0)
        x[:, -4] = np.bincount(owner, weights=same, minlength=len(start)) / per
        x[:, -3] = np.bincount(owner, weights=two, minlength=len(start)) / per
        x[:, -2] = np.bincount(owner[fresh], minlength=len(start)) / per
        x[:, -1] = np.bincount(owner, weights=(kind[begin] == 4), minlength=len(start)) / per
    return np.sqrt(x), count


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first, axis=0)


def _forward(p: dict, x: np.ndarray, count: np.ndarray):
    first = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(count)), count)
    h = np.tanh((x - p["mean"]) / p["sd"] @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * g) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, first)[doc])
    a = e / _sums(e, first)[doc]
    z = _sums(a[:, None] * h, first)
    s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
    return s, (first, doc, h, t, g, a, z)


def train(x: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict:
    """Parameters learned by Adam on the bags (x, count) with labels y; the same input gives the same result."""
    rng = np.random.default_rng(0)
    f, k, m = x.shape[1], HIDDEN, GATE
    p = {"W": rng.normal(0, f**-0.5, (f, k)), "b": np.zeros(k), "V": rng.normal(0, k**-0.5, (k, m)), "U": rng.normal(0, k**-0.5, (k, m)), "w": np.zeros(m), "c": np.zeros(k), "d": np.zeros(1)}
    fixed = {"mean": x.mean(axis=0) if len(x) else np.zeros(f), "sd": x.std(axis=0) + 1e-3 if len(x) else np.ones(f)}
    moment, square, step = {n: 0.0 for n in p}, {n: 0.0 for n in p}, 0
    if not len(y) or y.min() == y.max():
        p["d"][:] = 0.0 if not len(y) else 4.0 * (2 * y[0] - 1)
        return p | fixed
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both classes alike
    first = np.cumsum(count) - count
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            pick = order[i : i + BATCH]
            rows = np.concatenate([np.arange(first[d], first[d] + count[d]) for d in pick])
            xb, cb = x[rows], count[pick]
            s, (fi, doc, h, t, g, a, z) = _forward(p | fixed, xb, cb)
            dz = ((s - y[pick]) * weight[pick] / len(pick))[:, None]
            grad = {"c": (z * dz).sum(axis=0), "d": dz.sum(axis=0)}
            dzh = dz * p["c"]
            da = (h * dzh[doc]).sum(axis=1)
            de = a * (da - _sums(a * da, fi)[doc])
            grad["w"] = (t * g).T @ de
            dtg = de[:, None] * p["w"]
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            grad["V"], grad["U"] = h.T @ dt, h.T @ dg
            dh = a[:, None] * dzh[doc] + dt @ p["V"].T + dg @ p["U"].T
            dh *= 1 - h * h
            grad["W"], grad["b"] = ((xb - fixed["mean"]) / fixed["sd"]).T @ dh + 1e-4 * p["W"], dh.sum(axis=0)
            step += 1
            for n, v in grad.items():
                moment[n] = 0.9 * moment[n] + 0.1 * v
                square[n] = 0.999 * square[n] + 0.001 * v * v
                p[n] = p[n] - RATE * (moment[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.999**step)) + 1e-8)
    return p | fixed


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from docs and labels (doc_id, quality)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.min("y").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # a bounded number of rows: broadcast
    rows = common.id_text(docs).join(F.broadcast(y), "doc_id")

    def run(batches):
        for b in batches:
            raw, at = common.utf8_buffers(b.column("text"))
            x, n = passages(raw, at)
            size = [4 * FEATURES * int(v) for v in n]
            flat = x.astype("<f4").tobytes()
            cut = np.concatenate([[0], np.cumsum(size)]).tolist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([flat[i:j] for i, j in zip(cut, cut[1:])], pa.binary())], names=["doc_id", "y", "x"])

    got = rows.mapInArrow(run, "doc_id long, y int, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    xs = [np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES) for r in got]
    x = np.concatenate(xs) if xs else np.zeros((0, FEATURES), np.float32)
    return train(x, np.array([len(v) for v in xs], int), np.array([float(r["y"]) for r in got]))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with score in place of text."""
    spark = docs.sparkSession
    common.small_batches(spark)
    held = spark.sparkContext.broadcast({k: v.astype(np.float32) for k, v in model.items()})
    keep = [c for c in docs.columns if c != "text"]

    def run(batches):
        for b in batches:
            raw, at = common.utf8_buffers(b.column("text"))
            s = np.zeros(0)
            if len(b):
                x, n = passages(raw, at)
                s = _forward(held.value, x, n)[0]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s.astype(float))], names=[*keep, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{kinds}, score double")
