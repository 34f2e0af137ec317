import sys

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import helpers

import corpus_pipeline as cp
from quantloom.llm import near_duplicates as nd

SF = "/root/testdata/sf0.001"


def jaccard(a, b):
    x, y = set(nd.shingle_set(a).tolist()), set(nd.shingle_set(b).tolist())
    return 1.0 if not x and not y else len(x & y) / len(x | y)


def test_near_copies_against_all_pairs(spark):
    base = helpers.text(50, 300).split()
    rows = [(i, " ".join(base[:k] + ["new"] + base[k + 1 :]), "en", None) for i, k in enumerate((5, 60, 120, 200))] + [(10, " ".join(base), "en", "s"), (11, helpers.text(51, 200), None, "s"), (12, None, "x", "s"), (13, "", "x", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, root string")
    got = sorted(r.doc_id for r in nd.keep_one(docs).collect())
    assert got == [0, 11, 12]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in nd.keep_one(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    gone = set(texts) - kept
    assert gone and all(any(jaccard(texts[g], texts[d]) >= 0.8 for d in texts if d != g) for g in gone)
    left = sorted(kept)
    close = [(a, b) for i, a in enumerate(left) for b in left[:i] if jaccard(texts[a], texts[b]) >= 0.8]
    assert len(close) <= 0.05 * len(gone) + 1


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF).cache()
        n, m = docs.count(), out.count()
        assert 0 < m <= n, name
        if i + 1 < len(cp.STAGES):
            assert out.columns == columns, name
        docs = out
    assert docs.filter("size(ids) != n_pieces").count() == 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name


def test_near_copies_are_tested_before_links_are_thinned(spark):
    import random

    r, texts = random.Random(7), []
    for g in range(2):
        base = helpers.text(60 + g, 400).split()
        for _ in range(150):
            w = list(base)
            for k in r.sample(range(400), r.randrange(3, 8)):
                w[k] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(w))
    sets = [set(nd.shingle_set(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if root[a] != root[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                root = [root[b] if x == root[a] else x for x in root]
    want = [root.index(x) for x in sorted(set(root), key=root.index)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x.doc_id for x in nd.keep_one(docs).collect()) == want


def test_repeated_lines_neither_join_nor_part_texts(spark):
    line = "\nall of it was said before"
    texts = [helpers.text(70, 150) + line * 60, helpers.text(71, 150) + line * 60]
    for i in range(5):
        base = helpers.text(72 + i, 150)
        texts += [base + line, base + line * 11]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert jaccard(texts[0], texts[1]) < 0.1 and jaccard(texts[2], texts[3]) > 0.9
    assert sorted(x.doc_id for x in nd.keep_one(docs).collect()) == [0, 1, 2, 4, 6, 8, 10]


def test_sets_of_equal_fingerprint_are_candidates_and_tested(spark):
    texts = {1: helpers.text(80, 50), 2: helpers.text(81, 50), 3: helpers.text(80, 50) + " end", 4: helpers.text(82, 50)}
    nodes = spark.createDataFrame([(i, *[fp] * nd.WORDS) for i, fp in ((1, 5), (2, 5), (3, 5), (4, -6))], ["node", *nd.FP])
    chosen = nd.plan(nodes)
    found = nd.members(nodes, chosen, nd.furthest(0.8))
    assert {x.node for x in found.collect()} == {1, 2, 3}
    links = nd.tested_links(found, spark.createDataFrame(list(texts.items()), "node long, text string"), chosen, nd.furthest(0.8))
    assert {tuple(sorted((x.a, x.b))) for x in links.collect()} == {(1, 3)}


def test_thresholds_reach_the_recall(spark):
    """Planted pairs of a similarity just over 0.8 share a bucket as often as the plan says."""
    import random

    import numpy as np

    r, sets = random.Random(3), []
    for _ in range(300):
        x = [r.getrandbits(64) for _ in range(220)]
        sets += [x[:200], x[20:]]  # 180 of 220: 0.818
    fp = np.array([nd.fingerprint(np.array(x, np.uint64)) for x in sets])
    nodes = spark.createDataFrame([(i, *map(int, f.view(np.int64))) for i, f in enumerate(fp)], ["node", *nd.FP])
    chosen = nd.plan(nodes)
    apart = [[int(np.bitwise_count((a[w] ^ b[w]) & np.uint64(sum(1 << j for j in bits)))) <= t for w, bits, t in chosen] for a, b in zip(fp[::2], fp[1::2])]
    assert sum(map(any, apart)) >= 0.97 * len(apart)
    got = {x.node for x in nd.members(nodes, chosen, nd.furthest(0.8)).collect()}
    assert sum(2 * i in got and 2 * i + 1 in got for i in range(300)) >= 0.97 * 300


def test_odd_rows_and_clashing_names(spark):
    docs = helpers.odd(spark)
    for name, stage in cp.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count(), name
    out = cp.STAGES[0][1](spark, docs, SF)
    assert out.columns == docs.columns
