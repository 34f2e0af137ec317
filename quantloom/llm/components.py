"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _settle(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step: links (a > b) between larger and smaller nodes."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    large = both.filter("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
    small = large.join(low, F.col("a") == F.col("k"))
    small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return small.filter("a != b").distinct()


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of the links (a, b) of long ids; root is the smallest node that can be reached.

    Alternates large-star and small-star steps until the links no longer
    change; each step costs two sums and two joins and is cut from its lineage
    in the shared checkpoint folder.  No task sees a component as a whole.
    """
    links = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = common.cut(links, name)
    state = None
    while True:
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or now[0] == 0:
            break
        state = now
        links = common.cut(_settle(links), name)
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
