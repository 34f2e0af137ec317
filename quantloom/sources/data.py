"""Calendar, universe, point-in-time and local-market preparation; tables in and out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import windows as W

PRICES = "date ticker open high low close volume amount adj_factor adj_close is_tradable".split()


def load(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    return d.select(*columns) if columns else d


def save(df: DataFrame, path: str, schema=None) -> None:
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def check_columns(df: DataFrame, expected: list[str]) -> None:
    missing, extra = sorted(set(expected) - set(df.columns)), sorted(set(df.columns) - set(expected))
    if missing or extra:
        raise ValueError(f"missing columns {missing}, extra columns {extra}")


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
    """old and new rows with the new ones in place of old ones of the same key."""
    d = old.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col("_s").desc())
    return d.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_s")


def manifest(df: DataFrame, name: str) -> DataFrame:
    """One row: name, number of rows, and an order-free hash of all of them."""
    return df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("hash"))


def manifest_json(df: DataFrame, name: str) -> str:
    return json.dumps(manifest(df, name).first().asDict(), sort_keys=True)


def quality_report(df: DataFrame, fields: list[str]) -> DataFrame:
    cov = [(F.count(c) / F.nullif(F.count("*"), F.lit(0)) * 100).alias(f"coverage_{c}") for c in fields]
    return df.agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("tickers"), F.min("date").alias("first"), F.max("date").alias("last"), *cov)


def sessions(prices: DataFrame) -> DataFrame:
    return prices.select("date").distinct()


def next_session(dates: DataFrame, calendar: DataFrame, x: str = "date") -> DataFrame:
    """dates with the first session strictly after x (null beyond the last); a calendar has one row a session."""
    c = calendar.select(F.col("date").alias(x), F.lit(1).alias("_c"), F.col("date").alias("_d")).distinct()
    d = dates.select(x).distinct().withColumns({"_c": F.lit(2), "_d": F.lit(None).cast("date")})
    order = Window.orderBy(x, "_c").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    u = c.unionByName(d).withColumn("next", F.first("_d", ignorenulls=True).over(order)).filter("_c = 2").select(x, "next")
    return dates.join(u, x, "left")


def align_outer(prices: DataFrame) -> DataFrame:
    """The full grid of sessions and tickers with nulls where there is no row."""
    grid = sessions(prices).crossJoin(F.broadcast(prices.select("ticker").distinct()))
    return grid.join(prices, ["date", "ticker"], "left")


def universe(prices: DataFrame, cap: DataFrame, top: int = 20, least_adv: float = 100.0) -> DataFrame:
    """days_since_ipo, ADV (30 rows, 15 at least), membership among the largest liquid names, and the filters."""
    d = prices.join(cap.select("date", "ticker", "market_cap"), ["date", "ticker"], "left")
    d = d.withColumns({"days_since_ipo": F.datediff("date", F.min("date").over(Window.partitionBy("ticker"))), "adv": W.roll(F.avg, F.col("close") * F.col("volume"), 30, 15), "market_cap": W.forward_fill(F.col("market_cap"))})
    liquid = F.col("adv") >= least_adv
    none = F.max(F.when(liquid, F.col("market_cap"))).over(W.by_date()).isNull()
    order = Window.partitionBy("date", liquid).orderBy(F.when(none, F.col("adv")).otherwise(F.col("market_cap")).desc_nulls_last(), "ticker")
    d = d.withColumn("in_index", F.coalesce(liquid, F.lit(False)) & (F.row_number().over(order) <= top))
    ok = (F.col("days_since_ipo") >= 60) & (F.col("close") >= 1) & (F.coalesce("market_cap", F.lit(5e7)) >= 5e4)
    return d.select("date", "ticker", "days_since_ipo", "adv", "market_cap", "in_index", ok.alias("pass_all_filters"))


def suspensions(prices: DataFrame, least_volume: float, long_run: int = 5) -> DataFrame:
    """is_suspended, the length of the running streak, and whether it is long."""
    d = prices.withColumn("is_suspended", F.col("volume") < least_volume)
    change = F.when(F.col("is_suspended") != F.lag("is_suspended").over(W.by_ticker()), 1).otherwise(0)
    d = d.withColumn("_i", change).withColumn("_i", F.sum("_i").over(W.to_date()))
    run = Window.partitionBy("ticker", "_i").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    streak = F.sum(F.col("is_suspended").cast("int")).over(run)
    return d.withColumn("streak", streak).withColumn("long_suspension", F.col("streak") > long_run).drop("_i")


def price_limits(d: DataFrame, code: str = "ticker", ret: str = "ret") -> DataFrame:
    """limit_up and limit_down: 20 % for codes of the growth boards (688, 30), else 10 %, less half a point."""
    limit = F.when(F.col(code).startswith("688") | F.col(code).startswith("30"), 0.2).otherwise(0.1) - 0.005
    return d.withColumns({"limit_up": F.col(ret) >= limit, "limit_down": F.col(ret) <= -limit})


def panel_check(d: DataFrame) -> DataFrame:
    return d.groupBy("ticker").agg(
        F.count("*").alias("n"), F.avg(F.col("ret").isNull().cast("double")).alias("null_ret"), F.avg((F.col("volume") == 0).cast("double")).alias("zero_volume"), F.sum((F.abs("ret") > 0.22).cast("long")).alias("jumps")
    )


def exchange_code(x):
    """Column: sh.600000 to 600000.SH."""
    return F.concat(F.split(x, r"\.")[1], F.lit("."), F.upper(F.split(x, r"\.")[0]))
