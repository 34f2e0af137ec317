import sys

import numpy as np

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import helpers
from pyspark.sql import functions as F

from quantloom.llm import common, language_id as li


def test_lower_matches_python():
    text = "ÀÉÎÕÜÞ×ß Zürich\tABC\n"
    assert li.lower(np.frombuffer(text.encode(), np.uint8)).tobytes().decode() == text.lower().replace("\t", " ").replace("\n", " ")


def test_em_matches_plain_loops():
    rng = np.random.default_rng(0)
    word = np.log(rng.random((30, 3))).astype(np.float32)
    first = np.array([0, 12, 13])
    share, ll = li.shares(word, first, np.ones((3, 3), np.float32))
    for d, (a, b) in enumerate(zip(first, [12, 13, 30])):
        p, s = np.exp(word[a:b].astype(float)), np.ones(3) / 3
        for _ in range(li.ROUNDS):
            r = p * s
            s = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        assert np.allclose(share[d], s, atol=1e-4) and abs(ll[d] - np.log((p * s).sum(axis=1)).sum()) < 1e-2


def test_held_out_accuracy_and_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = li.held_out(F.col("doc_id"), 5, 0)
    model = li.learn(docs.filter(~out))
    got = li.identify(common.id_text(docs).withColumn("out", out), model).filter("out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    two = docs.filter("n_chars > 1500").groupBy("lang").agg(F.min_by("text", "doc_id").alias("t")).collect()
    t = {r.lang: r.t[:1400] for r in two}
    mixed = spark.createDataFrame([(1, t["de"] + " " + t["en"][:600])], "doc_id long, text string")
    r = li.identify(mixed, model).first()
    assert r.lang_pred == "de" and 0.5 < r.score < 0.9


def test_odd_rows(spark):
    d = helpers.odd(spark)
    got = li.identify(common.id_text(d), li.learn(d)).collect()
    assert len(got) == len(helpers.odd_rows())
    for r in got:
        text = dict((x[0], x[1]) for x in helpers.odd_rows())[r.doc_id] or ""
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text))
        assert 0 <= r.score <= 1


def test_empty(spark):
    none = helpers.none(spark)
    model = li.learn(none)
    assert model[0] == [] and li.identify(common.id_text(none), model).collect() == []
    assert {r.lang_pred for r in li.identify(common.id_text(helpers.odd(spark)), model).collect()} == {"und"}


def test_languages_and_proportions_of_four_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = li.learn(docs)
    some = docs.filter("n_chars > 1500").groupBy("lang").agg(F.min_by("text", "doc_id").alias("t")).collect()
    assert len(some) == len(model[0]) == 4
    t = {r.lang: r.t[:1400] for r in some}
    mixed = spark.createDataFrame([(1, " ".join(t.values())), (2, t["de"]), (3, "12 34")], "doc_id long, text string")
    four, one, none = sorted(li.identify(mixed, model).collect(), key=lambda r: r.doc_id)
    assert sorted(four.languages) == sorted(t) and four.score < 0.33
    assert abs(sum(four.proportions) - 1) < 1e-5 and four.proportions == sorted(four.proportions, reverse=True)
    assert (four.languages[0], four.proportions[0]) == (four.lang_pred, four.score)
    assert one.languages[0] == "de" and (none.languages, none.proportions) == ([], [])
