"""Registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(common.documents(spark, sf_dir)).drop("th")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    trusted = common.table(spark, sf_dir, "labels").filter("quality = 1")
    return quality_rules(common.documents(spark, sf_dir), trusted)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate.decontaminate(common.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return d.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan

    return scan(common.documents(spark, sf_dir))


def op5_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree_lm import score

    return score(common.documents(spark, sf_dir))


def op6_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import passage_quality as pq
    from .language_id import held_out

    docs = common.id_text(common.documents(spark, sf_dir))
    out = held_out(F.col("doc_id"), 3, 1)
    model = pq.learn(docs.filter(~out), common.table(spark, sf_dir, "labels"))
    scored = pq.score(docs.withColumn("held_out", out), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(common.documents(spark, sf_dir))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import pieces

    docs = common.id_text(common.documents(spark, sf_dir))
    return pieces.encode(docs, public_tokenizers.path(pieces.MODEL), with_ids=False)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id as li

    docs = common.documents(spark, sf_dir)
    out = li.held_out(F.col("doc_id"), 5, 0)
    model = li.learn(docs.filter(~out))
    return li.identify(common.id_text(docs).withColumn("held_out", out), model)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_files

    path = common.folder(spark, "tokens")
    ids = token_files.encode(common.documents(spark, sf_dir), public_tokenizers.path(token_files.TOKENIZER))
    token_files.write(ids, path)
    return token_files.read(spark, path, with_ids=False)


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontaminate": op3_decontaminate,
    "op4_licences": op4_licences,
    "op5_suffix_tree_lm": op5_suffix_tree_lm,
    "op6_passage_quality": op6_passage_quality,
    "op7_simhash": op7_simhash,
    "op8_pieces": op8_pieces,
    "op9_language_id": op9_language_id,
    "op10_token_files": op10_token_files,
}
ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": decontaminate.ORACLE,
}
