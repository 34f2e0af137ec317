import math
import sys
import zlib
from collections import Counter

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import helpers

from quantloom.llm import common, suffix_tree_lm as lm


def toks(t):
    return (t or "").translate(str.maketrans(common.UPPER, common.LOWER)).encode().split() + [b"\n"]


def brute(rows):
    """Base fields of rows (doc_id, text)."""
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    c = Counter(w for (d, t), h in zip(rows, held) if not h for w in toks(t))
    n, v = sum(c.values()), len(c)
    out = []
    for (d, t), h in zip(rows, held):
        w = toks(t)
        out.append((d, h, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)))
    return out


def compare(spark, docs):
    got = lm.score(docs).collect()
    rows = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got if r.doc_id is not None)
    want = sorted(x for x in brute([(r["doc_id"], r["text"]) for r in docs.collect()]) if x[0] is not None)
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-4 * max(1, abs(b[5])), (a, b)
    return got


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "WORDS", 20)  # most words are joined
    compare(spark, helpers.odd(spark))


def test_table_and_held_out_gain(spark):
    got = compare(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)


def test_joined_tree_gives_the_same(spark, monkeypatch):
    docs = helpers.odd(spark)
    monkeypatch.setattr(lm, "LEAST", 5)
    want = compare(spark, docs)
    monkeypatch.setattr(lm, "TREE_ROWS", 0)
    got = compare(spark, docs)
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.n_tokens)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and abs(a.score - b.score) < 1e-4 * max(1, abs(b.score)), (a, b)


def plain_tree(texts, least):
    """(context bytes, newest first) -> symbol probabilities of the kept contexts, with plain loops."""
    n = {}
    for t in texts:
        s = b" ".join(toks(t)[:-1])
        s = s + b" \n" if s else b"\n"
        past = bytes([10]) + bytes(lm.DEPTH)
        for x in s:
            for d in range(lm.DEPTH + 1):
                n.setdefault(past[:d], Counter())[x] += 1
            past = (bytes([x]) + past)[: lm.DEPTH]
    prob, kept = {}, set()
    for c in sorted(n, key=len):
        t = sum(n[c].values())
        if t < least:
            continue
        up = prob[c[:-1]] if c else [1 / 256] * 256
        prob[c] = [(n[c][x] + lm.PULL * up[x]) / (t + lm.PULL) for x in range(256)]
        if len(c) < 2 or sum(k * math.log(k / t / up[x]) for x, k in n[c].items()) >= lm.DIVERGENCE:
            kept |= {c[:d] for d in range(len(c) + 1)}
    return {c: prob[c] for c in kept}


def test_scores_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST", 6)
    docs = helpers.odd(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    train = [r.text for r in docs.collect() if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2]
    tree, c = plain_tree(train, 6), Counter(w for t in train for w in toks(t))
    assert {len(x) for x in tree} == set(range(lm.DEPTH + 1))
    total, want = sum(c.values()) + len(c) + 1, {}
    for d, t in rows:
        past, score = bytes([10]) + bytes(lm.DEPTH), 0.0
        for w in toks(t):
            spell = 1.0
            for x in w if w == b"\n" else w + b" ":
                k = max((past[:i] for i in range(lm.DEPTH + 1) if past[:i] in tree), key=len)
                spell *= tree[k][x]
                past = (bytes([x]) + past)[: lm.DEPTH]
            score += math.log10(lm.SHARE * (c[w] + 1) / total + (1 - lm.SHARE) * spell)
        want[d] = score
    for r in lm.score(docs).collect():
        if r.doc_id is not None:
            assert abs(r.score - want[r.doc_id]) < 1e-3 * max(1, abs(want[r.doc_id])), r


def test_more_text_grows_the_tree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = [lm.learn_tree(lm.count(x)[0]).filter("s < 0").count() for x in (docs.filter("doc_id % 4 = 0"), docs)]
    assert sizes[1] > 1.5 * sizes[0], sizes


def test_empty(spark):
    assert lm.score(helpers.none(spark)).collect() == []
