import re
import sys

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import helpers

from quantloom.llm import common, decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(common.UPPER, common.LOWER)))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(w) for w in wins}
    out = {}
    for d, t in docs:
        w = words(t)
        hit, got = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    got |= wins[x]
        out[d] = (len(w), len(hit), sorted(str(i) for i in got if i is not None))
    return out


def check(spark, docs, items):
    b = spark.createDataFrame(items, "item_id long, text string, doc_id long")
    got = decontaminate.decontaminate(docs, b).collect()
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [i[:2] for i in items])
    assert {r.doc_id: (r.n_words, r.n_hit, list(r.items)) for r in got} == want
    return want


def test_odd_rows(spark):
    t = helpers.odd_rows()[6][1].split()
    items = [(1, " ".join(t[40:65]), 1), (2, " ".join(t[50:59]).upper(), 1), (3, None, 1), (4, "", None), (10, "der der der", 1), (10, "der der der", 1), (11, " ".join(t[300:312]) + "!", 2), (None, " ".join(t[100:120]), 2), (12, "ß", 1)]
    want = check(spark, helpers.odd(spark), items)
    assert any(v[1] for v in want.values())


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    b = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    want = check(spark, docs, [(r.item_id, r.text, 0) for r in b])
    assert any(v[1] for v in want.values())


def test_large_benchmark_is_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 2)
    t = helpers.odd_rows()[6][1].split()
    check(spark, helpers.odd(spark), [(1, " ".join(t[40:65]), 1), (2, " ".join(t[2:30]), 1)])


def test_empty_tables(spark):
    none = helpers.none(spark)
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(none, items).collect() == []
    assert decontaminate.decontaminate(helpers.odd(spark), items).filter("n_hit > 0").count() == 0
