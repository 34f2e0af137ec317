import re
import sys
from collections import Counter

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import helpers

from quantloom.llm import quality_rules as qr


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(wins)
    rep = len({i + j for i, w in enumerate(wins) if n[w] > 1 for j in range(3)})
    sym = sum((text or "").count(c) for c in qr.SYMBOLS)
    return len(words), sum(map(len, words)), sym, len(lines) - len(set(lines)), rep, len(words) < 50 or 100 * rep > 50 * len(words)


def fields(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_base_counts(spark):
    docs = helpers.odd(spark)
    trusted = spark.createDataFrame([(5,), (6,), (6,), (None,)], "doc_id long")
    got = qr.quality_rules(docs, trusted).collect()
    want = {r[0]: base(r[1]) for r in helpers.odd_rows()}
    assert len(got) == len(helpers.odd_rows())
    assert {r.doc_id: fields(r) for r in got} == want
    assert not any(r.kept for r in got if r.base_failed)


def test_table_and_llr(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in qr.quality_rules(docs, labels.filter("quality = 1")).collect()}
    for r in docs.collect():
        assert fields(got[r.doc_id]) == base(r.text)
    label = {r.doc_id: r.quality for r in labels.collect()}
    kept = [got[d].kept for d, q in label.items() if q == 1 and not got[d].base_failed]
    assert sum(kept) >= 0.97 * len(kept)


def test_ratios_match_plain_counts(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "doc_id long, text string")
    import math

    got = qr.log_ratios(docs, spark.createDataFrame([(1,)], "doc_id long"))
    rows = docs.select("doc_id", qr.grams(qr.common.words_of(docs["text"])).alias("grams")).collect()
    raw = Counter(g for r in rows for g in r.grams)
    tgt = Counter(g for r in rows if r.doc_id == 1 for g in r.grams)
    n, m = sum(raw.values()) + qr.BUCKETS, sum(tgt.values()) + qr.BUCKETS
    assert all(abs(got[g] - math.log((tgt[g] + 1) / m / ((raw[g] + 1) / n))) < 1e-9 for g in range(qr.BUCKETS))


def test_llr_and_kept_match_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    trusted = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").filter("quality = 1")
    weights = qr.log_ratios(docs, trusted)
    rows = docs.select("doc_id", qr.grams(qr.common.words_of(docs["text"])).alias("g")).collect()
    want = {r.doc_id: sum(weights[g] for g in r.g) / len(r.g) if r.g else None for r in rows}
    for r in qr.quality_rules(docs, trusted).collect():
        assert r.llr is None if want[r.doc_id] is None else abs(r.llr - want[r.doc_id]) < 1e-9
        assert r.kept == (not r.base_failed and (r.llr or 0.0) >= qr.THRESHOLD)


def test_empty(spark):
    none = helpers.none(spark)
    assert qr.quality_rules(none, none.select("doc_id")).collect() == []
    assert qr.quality_rules(helpers.odd(spark), none.select("doc_id")).filter("not base_failed and not kept").count() == 0
