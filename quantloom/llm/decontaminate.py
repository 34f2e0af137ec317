"""Benchmark decontamination by winnowing.

Texts are word sequences.  A window is WINDOW consecutive words of a benchmark
item (an item of fewer words is one window).  Every window of WINDOW words
keeps the minimum hash of its GRAM-word grams; equal windows keep equal minima,
so joining the minima of documents with those of the benchmark misses no
shared window.  Hits are extended to all windows that keep the joined minimum
and compared word by word with the benchmark's windows.

All steps are DataFrame functions.  The documents are not shuffled before the
join when the benchmark's fingerprints are few (counted first); otherwise both
sides are.  Only hits are grouped by document.

Defined results: null text has no words; an empty benchmark leaves all
documents clean; an empty table gives an empty result; items without words
occur nowhere; null item_ids are not counted; repeated rows each return their
result; rows are told apart by doc_id and text.  Texts of any length are
processed whole.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, GRAM = 10, 5
#: Fingerprints, and windows, of a benchmark that are broadcast at most.
BROADCAST_ROWS = 50_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def _gram(at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get("words", at + k) for k in range(size)])


def _short(size: int):
    return lambda i: F.struct(F.lit(size).alias("size"), _gram(i, size).alias("fp"), i.alias("at"), F.slice("words", i + 1, size).alias("part"))


def fingerprints(df: DataFrame, window: int, gram: int, lengths: list[int]) -> DataFrame:
    """df (with words) times its fingerprints: size, fp, at (first window), part (the words of all windows of the run).

    lengths: sizes below ``window`` whose windows are wanted too, each window by its own hash.
    """
    n = F.size("words")
    d = df.withColumn("_h", F.transform(F.when(n >= window, F.sequence(F.lit(0), n - gram)).otherwise(F.array().cast("array<int>")), lambda i: _gram(i, gram)))
    width = window - gram + 1
    # _h is named outside the lambda too: a column that is named once would be put into it and computed for each window.
    d = d.withColumn("_m", F.transform(F.when(n >= window, F.sequence(F.lit(1), F.size("_h") - width + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_min(F.slice("_h", i, width))))
    # Windows that begin a run of one minimum, and the window after the last one.
    first = F.filter(F.transform("_m", lambda m, i: F.when((i == 0) | (m != F.get("_m", i - 1)), i)), lambda i: i.isNotNull())
    d = d.withColumn("_first", F.concat(first, F.array(F.size("_m"))))
    run = lambda i, k: F.struct(F.lit(window).alias("size"), F.get("_m", i).alias("fp"), i.alias("at"), F.slice("words", i + 1, F.get("_first", k + 1) - i + window - 1).alias("part"))
    runs = F.transform(F.expr("slice(_first, 1, size(_first) - 1)"), run)
    for size in lengths:
        at = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
        runs = F.concat(runs, F.transform(at, _short(size)))
    keys = [c for c in df.columns if c != "words"]
    # The outer form, as a filter would otherwise be made of the arrays and computed twice.
    return d.select(*keys, F.explode_outer(runs).alias("_r")).filter("_r is not null").select(*keys, "_r.*")


def windows(runs: DataFrame) -> DataFrame:
    """One row per window of each run: at, and the words as one string."""
    keys = [c for c in runs.columns if c not in ("part", "at", "fp")]
    d = runs.select(*keys, "at", "part", F.explode_outer(F.sequence(F.lit(0), F.size("part") - F.col("size"))).alias("_k"))
    return d.select(*keys, (F.col("at") + F.col("_k")).alias("at"), F.array_join(F.slice("part", F.col("_k") + 1, F.col("size")), " ").alias("window"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, th (hash of the text), n_words, n_hit, n_items, items (sorted strings), hits (start and end words) of every row."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text").cast("string")).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("n", F.size("words"))
    sizes = items.filter(F.size("words") < window).select(F.size("words").alias("n")).distinct().collect()  # window - 1 rows at most
    lengths = sorted(r["n"] for r in sizes)
    # Windows of short sizes are wanted of short items only.
    grams = fingerprints(items, window, gram, lengths).filter((F.col("size") == window) | (F.col("size") == F.col("n")))
    known = windows(grams).groupBy("size", "window").agg(F.collect_set("item").alias("items"))
    marks = grams.select("size", "fp").distinct()
    few = marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    held = F.broadcast if few else (lambda df: df)

    d = common.id_text(docs).select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("words"))
    found = fingerprints(d, window, gram, lengths).join(held(marks), ["size", "fp"], "left_semi")
    hits = windows(found).join(held(known), ["size", "window"])
    per_doc = hits.groupBy("doc_id", "th").agg(
        F.array_sort(F.collect_set(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("size")).alias("b")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    per_doc = per_doc.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "hits", "items")
    covered = F.aggregate("hits", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda s, h: F.struct(F.greatest(s["end"], h["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), h["b"] - F.greatest(s["end"], h["a"]))).alias("n")))["n"]
    all_docs = d.select("doc_id", "th", F.size("words").cast("long").alias("n_words"))
    out = all_docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "th", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size(F.coalesce("items", none)), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), "hits",
    )


#: The registered query, window by window, for DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM s)),
g AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM s) WHERE len(w) >= n)),
h AS (SELECT g.doc_id, g.i, g.n, k.item_id FROM g JOIN k ON g.n = k.n AND g.win = k.win),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
