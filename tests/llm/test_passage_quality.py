import sys

import numpy as np

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import helpers
from pyspark.sql import functions as F

from quantloom.llm import common, passage_quality as pq
from quantloom.llm.language_id import held_out


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_passages_of_a_document_do_not_depend_on_its_neighbours():
    texts = [helpers.text(i, n) for i, n in enumerate((1, 50, 900, 0, 3000))] + ["", "\n"]
    x, n = pq.passages(*buffers(texts))
    assert n.min() >= 1 and n.sum() == len(x) and n[4] > 10
    at = 0
    for t, k in zip(texts, n):
        y, m = pq.passages(*buffers([t]))
        assert m[0] == k and np.allclose(x[at : at + k], y, atol=1e-5)
        at += k


def test_gradient_step_learns_from_one_bad_passage():
    rng = np.random.default_rng(0)
    count = rng.integers(2, 8, 400)
    y = rng.integers(0, 2, 400)
    x = rng.normal(0, 0.3, (count.sum(), pq.FEATURES)).astype(np.float32)
    first = np.cumsum(count) - count
    x[first[y == 0] + rng.integers(0, count[y == 0]), 3] += 4  # one passage gives a bad document away
    p = pq.train(x, count, y.astype(float))
    s, (_, _, _, _, _, a, _) = pq._forward(p, x, count)
    assert ((s >= 0.5) == (y == 1)).mean() > 0.95
    assert np.allclose(np.add.reduceat(a, first), 1)


def test_held_out_quality(spark):
    docs = common.id_text(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = held_out(F.col("doc_id"), 3, 1)
    got = pq.score(docs.filter(out), pq.learn(docs.filter(~out), labels)).join(labels, "doc_id").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean(np.array(good) >= 0.5) > 0.95 and np.mean(np.array(bad) < 0.5) > 0.85


def test_odd_rows_and_no_labels(spark):
    d = common.id_text(helpers.odd(spark))
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (6, 0, 0), (13, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = pq.score(d, pq.learn(d, labels)).collect()
    assert len(got) == len(helpers.odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in pq.score(d, pq.learn(d, labels.limit(0))).collect()} == {0.5}
    assert pq.score(common.id_text(helpers.none(spark)), pq.learn(d, labels)).collect() == []
