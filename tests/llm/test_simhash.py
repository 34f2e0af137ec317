import sys

import numpy as np
import pytest
import xxhash

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import helpers

from quantloom.llm import common, simhash
from quantloom.llm.components import components


def plain_fingerprint(text):
    words = (text or "").translate(str.maketrans(common.UPPER, common.LOWER)).encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def roots(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, limit=3):
    fp = {}
    for d, t in rows:
        fp.setdefault(plain_fingerprint(t), []).append(d)
    keys = sorted(fp)
    a = np.array(keys, np.uint64)
    x, y = np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= limit)
    r = roots(keys, [(keys[i], keys[j]) for i, j in zip(x, y) if i < j])
    least = {}
    for k in keys:
        for d in fp[k]:
            if d is not None:
                least[r[k]] = min(d, least.get(r[k], d))
    return {d: (f"{k:016x}", least.get(r[k])) for k in keys for d in fp[k]}


def test_odd_rows(spark):
    got = simhash.near_duplicates(helpers.odd(spark)).collect()
    assert len(got) == len(helpers.odd_rows())
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == brute([r[:2] for r in helpers.odd_rows()])


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("limit", [3, 6])
def test_links_connect_what_brute_force_connects(spark, limit, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 40)  # so that buckets are cut into blocks
    rng = np.random.default_rng(limit)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:20]:
        for _ in range(15):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    signed = np.array(sorted(fps), np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    got = [(r.a, r.b) for r in simhash.links(df, limit).collect()]
    u = signed.view(np.uint64)
    x, y = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= limit)
    nodes = signed.tolist()
    assert roots(nodes, got) == roots(nodes, [(nodes[i], nodes[j]) for i, j in zip(x, y) if i < j])
    where = {n: i for i, n in enumerate(nodes)}
    assert all(bin(int(u[where[a]] ^ u[where[b]])).count("1") <= limit for a, b in got)


def test_thresholds_keep_the_principle():
    costs = [[0.0, 5.0, 50.0, 500.0, 5000.0]] * 2
    assert sum(simhash.allot(costs, 3)[1]) == 3 - 2 + 1


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 99), (99, 98)], "a long, b long")
    got = {r.node: r.root for r in components(df, "test").collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 98: 98, 99: 98, 100: 98}


def test_empty_table(spark):
    assert simhash.near_duplicates(helpers.none(spark)).collect() == []
