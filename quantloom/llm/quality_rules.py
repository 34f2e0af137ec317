"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into BUCKETS counts.  Two multinomials with
add-one smoothing, one of the trusted target texts and one of the raw corpus,
give each bucket its log-likelihood ratio; a text's score is the mean over its
n-grams (so it does not depend on length), and texts below THRESHOLD go.

All steps are DataFrame functions.  The corpus is summed to BUCKETS rows
before it is shuffled to the driver; the ratios return as one literal array.

Defined results: null text is empty, has no words and fails the base rules;
repeated rows each return their result; null doc_ids are kept as they are; an
empty table gives an empty result; without trusted texts all ratios are 0 and
the base rules decide.  Texts of any length are processed whole.  Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Symbols that are counted.
SYMBOLS = "#*$%&|<>"
BUCKETS, THRESHOLD = 10_000, -0.35
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _hash(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int")


def _let(value: Column, body) -> Column:
    """body(value), value being worked out once: however often the result is used, nothing is worked out twice inside."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(words: Column, size: int, of) -> Column:
    """of(word, place) of every place at which a run of ``size`` words begins."""
    return F.slice(F.transform(words, of), F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(0)))


def grams(words: Column) -> Column:
    """The buckets of all words and word pairs, lower-cased."""

    def both(low: Column) -> Column:
        one = F.transform(low, lambda w: F.pmod(w, F.lit(BUCKETS)).cast("int"))
        return F.concat(one, _runs(low, 2, lambda w, i: _hash(w, F.get(low, i + 1))))

    return _let(F.transform(words, lambda w: F.xxhash64(F.lower(w))), both)


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """Log-likelihood ratio of each bucket; trusted: doc_ids of the target texts."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct().withColumn("t", F.lit(1))
    # The texts meet the labels before their grams are made: a text is smaller than its grams.  One plan at every size.
    marked = common.id_text(docs).join(ids.hint("merge"), "doc_id", "left")
    rows = marked.select(F.explode(_let(common.words_of(F.col("text")), grams)).alias("g"), "t").groupBy("g").agg(F.count("*").alias("raw"), F.count("t").alias("target")).collect()  # BUCKETS rows at most
    raw, target = [1.0] * BUCKETS, [1.0] * BUCKETS
    for r in rows:
        raw[r["g"]] += r["raw"]
        target[r["g"]] += r["target"]
    if sum(target) == BUCKETS:
        return [0.0] * BUCKETS
    shift = math.log(sum(raw) / sum(target))
    return [math.log(t / n) + shift for t, n in zip(target, raw)]


def repeat_words(words: Column) -> Column:
    """The count of words in 3-word windows found twice or more.

    A window's key holds its hash above and its place below; sorted keys put
    equal windows side by side, and neighbours count if their words are equal.
    """

    def count(bits: Column) -> Column:
        hashed = lambda k: F.call_function("shiftright", k, bits)
        place = lambda k: (k - F.call_function("shiftleft", hashed(k), bits)).cast("int")
        same = lambda a, b: (hashed(a) == hashed(b)) & F.forall(F.array(*[F.lit(j) for j in range(3)]), lambda j: F.get(words, place(a) + j) == F.get(words, place(b) + j))
        pairs = lambda keys: F.zip_with(keys, F.slice(keys, F.lit(2), F.greatest(F.size(keys) - 1, F.lit(0))), lambda a, b: F.when(same(a, b), F.array(place(a), place(b))))
        keys = F.sort_array(_runs(words, 3, lambda w, i: F.call_function("shiftleft", F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)), bits) + i))
        hits = F.sort_array(F.array_distinct(F.flatten(F.array_compact(_let(keys, pairs)))))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum"))
        return F.aggregate(hits, start, lambda s, p: F.struct(p.alias("last"), (s["sum"] + F.least(F.lit(3), p - s["last"])).alias("sum")))["sum"]

    return _let(F.length(F.bin(F.size(words))), count)


def _literal(spark: SparkSession, values: list[float]) -> Column:
    """An array of doubles as one literal (F.lit would make an expression for each of them)."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    array = gateway.new_array(jvm.double, len(values))
    jvm.java.nio.ByteBuffer.wrap(struct.pack(f">{len(values)}d", *values)).asDoubleBuffer().get(array)
    return Column(jvm.org.apache.spark.sql.functions.lit(array))


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept of every row."""
    weights = _literal(docs.sparkSession, log_ratios(docs, trusted))
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    score = lambda g: F.try_divide(F.aggregate(g, F.lit(0.0), lambda s, x: s + F.get(weights, x)), F.size(g))

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(words).cast("long").alias("n_repeat_words"),
            _let(grams(words), score).alias("llr"),
        )

    d = common.id_text(docs).select("doc_id", _let(common.words_of(text), counts).alias("r")).select("doc_id", "r.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    return d.withColumn("kept", ~F.col("base_failed") & (F.coalesce("llr", F.lit(0.0)) >= threshold))
