import hashlib
import sys

import numpy as np

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import helpers

from quantloom.llm import induced, suffix_dedup


def brute(rows, width):
    """rows: (key, bytes) in order."""
    first, out = {}, {}
    for key, raw in rows:
        gone = bytearray(len(raw))
        for s in range(len(raw) - width + 1):
            w = raw[s : s + width]
            if w in first:
                gone[s : s + width] = b"\1" * width
            else:
                first[w] = (key, s)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[key] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_order_matches_plain_sort():
    rng = np.random.default_rng(0)
    for trial in range(40):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(2, 300)).astype(np.uint16)
        if trial % 3 == 0:
            t = np.tile(t[: max(1, len(t) // 9)], 9)
        got = induced.suffix_order(t, int(t.max()) + 1, 10**6, budget=64 if trial % 2 else 1 << 20)
        plain = t.tolist()
        assert got.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])


def test_odd_rows_match_brute_force(spark):
    got = suffix_dedup.remove_repeats(helpers.odd(spark)).collect()
    texts = {r[0]: (r[1] or "").encode() for r in helpers.odd_rows()}
    want = brute(sorted(texts.items(), key=lambda x: (x[0] is not None, x[0] or 0)), 100)
    assert len(got) == len(helpers.odd_rows())
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r


def test_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, (r.text or "").encode()) for r in docs.orderBy("doc_id").collect()], 100)
    got = suffix_dedup.remove_repeats(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert sum(w[1] for w in want.values()) > 0


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(helpers.none(spark), with_text=True).collect() == []


def test_rows_of_one_doc_id_are_told_apart(spark):
    # 1000 rows of null doc_id: 16 bits of a hash would give several pairs one key.
    rows = [(None, helpers.text(5000 + i // 2, 30 + i % 2 * 9)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs, with_text=True)
    keys = got.select("th").distinct().count()
    assert keys == len({t for _, t in rows})
    order = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) h").collect()}
    alone = [(k, t) for k, t in enumerate(sorted(order, key=order.get))]
    want = suffix_dedup.remove_repeats(spark.createDataFrame(alone, docs.schema), with_text=True)
    cols = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
