"""Corpus preparation: quality, near-duplicates, repeated passages, benchmark leaks, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before kept.  The stages need no column but doc_id and text and pass all others
through; null and empty texts, repeated rows and empty tables have the results
that the operators define.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import common, decontaminate, near_duplicates, passage_quality, pieces, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents to which the passage classifier gives a score below one half."""
    columns = docs.columns
    model = passage_quality.learn(docs, common.table(spark, sf_dir, "labels"))
    row = F.struct(*[docs[c] for c in columns]).alias("row")
    scored = passage_quality.score(docs.select(row, F.col("text").cast("string").alias("text")), model)
    return scored.filter("score >= 0.5").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates."""
    return near_duplicates.keep_one(docs)


def _keyed(docs: DataFrame, key: Column) -> DataFrame:
    """Each row as one value (its columns may have any names), and the key by which results find it."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.struct(docs["doc_id"].cast("long").alias("doc_id"), key.alias("th")).alias("_key"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; n_chars, where documents have it, follows."""
    kept = suffix_dedup.remove_repeats(docs, with_text=True).filter("n_removed > 0")
    kept = kept.select(F.struct("doc_id", "th").alias("_cut"), "kept_text").dropDuplicates(["_cut"])
    d = _keyed(docs, suffix_dedup.text_key(docs["text"].cast("string"))).join(kept, F.col("_key").eqNullSafe(F.col("_cut")), "left")
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    cut = F.col("kept_text").isNotNull()
    return d.select(*[(F.when(cut, new[c]).otherwise(F.col("_row")[c]) if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark")).filter("n_hit > 0")
    found = found.select(F.struct("doc_id", "th").alias("_hit")).distinct()
    d = _keyed(docs, F.xxhash64(docs["text"].cast("string")))
    return d.join(found, F.col("_key").eqNullSafe(F.col("_hit")), "left_anti").select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, text as decoded from the ids (null stays null), and the ids of the best segmentation and the
    scores of the N best; a column of documents that has a result's name gives way to it."""
    import public_tokenizers

    d = docs.drop(*pieces.RESULTS).withColumn("text", F.col("text").cast("string"))
    return pieces.encode(d, public_tokenizers.path(pieces.MODEL)).drop("ids_crc32", "nbest_crc32s", "round_trip")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", leaks),
    ("SentencePiece encoding and decoding", encode),
]
#: Learned scores and fingerprints are no SQL; the stages are tested against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = common.documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.stored(docs, name.replace(" ", "-"))
    return docs
