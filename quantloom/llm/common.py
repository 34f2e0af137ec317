"""Small helpers shared by the text operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, \n, \v, \f, \r.
SPACE = r"[\x20\x09-\x0D]+"
#: A-Z lower-cased, and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, so that extra columns of any name cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def words_of(text: Column) -> Column:
    """Array of words; null or blank text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; without one, a temporary folder in local mode and an error on a cluster."""
    import tempfile

    top = spark.conf.get("spark.checkpoint.dir", "")
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return top.rstrip("/") or tempfile.gettempdir()


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read again from the shared checkpoint folder (``shared_folder``)."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", "") and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/quantloom-{name}")
    return df.checkpoint(eager=True)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def fnv(words: list[bytes], seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte strings."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


#: Bytes after which an Arrow batch is passed to a worker.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few bytes, for workers stay small when texts are very long.

    Lazy frames read the setting when they run, so it stays; it is the same for
    all operators, never raises what the session asks for, and no limit of rows changes.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def utf8_buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string array as one buffer, and the offsets of its rows (null: empty)."""
    import pyarrow as pa

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the cluster shares."""
    import uuid

    return f"{shared_folder(spark)}/quantloom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a compressed table in the shared folder: cuts the lineage like ``cut`` and takes less disk.

    What its steps shuffled is removed when it has been written.
    """
    spark = df.sparkSession
    path, key = folder(spark, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, was)
    return spark.read.parquet(path)
