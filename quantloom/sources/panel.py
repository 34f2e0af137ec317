"""The panel of daily bars and its companions, derived from the order tables.

A supplier is a ticker and a shipping date a session; the unit price of a
day's lines is the close.  Sums of money are exact decimals, so every engine
gets the same bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import by_ticker, div


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prices(spark: SparkSession, sf_dir: str, weekly: bool = False) -> DataFrame:
    """date, ticker, open, high, low, close, volume, amount; one exchange on (ticker, date)."""
    day = F.col("l_shipdate").cast("date")
    day = F.trunc(day, "week") if weekly else day
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    first = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return (
        read(spark, sf_dir, "lineitem")
        .select(day.alias("date"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), "l_quantity", "l_extendedprice", unit.alias("unit"), first.alias("first"))
        .groupBy("date", "ticker")
        .agg(
            F.min_by("unit", "first").alias("open"),
            F.max("unit").alias("high"),
            F.min("unit").alias("low"),
            (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.sum("l_quantity")).alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"),
        )
    )


def bars(spark: SparkSession, sf_dir: str, weekly: bool = False) -> DataFrame:
    """prices without open: no ordered aggregate is needed, so the sum stays hash-based."""
    day = F.col("l_shipdate").cast("date")
    day = F.trunc(day, "week") if weekly else day
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    money = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(day.alias("date"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"))
        .agg((money / F.sum("l_quantity")).alias("close"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.sum("l_quantity").alias("volume"), money.alias("amount"))
    )


def returns(spark: SparkSession, sf_dir: str, weekly: bool = False) -> DataFrame:
    """bars with ret, the change of close from the ticker's last row."""
    return bars(spark, sf_dir, weekly).withColumn("ret", div(F.col("close"), F.lag("close").over(by_ticker())) - 1)


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, sector (region) and industry (nation): a small dimension."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    d = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return d.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statements: ticker, report_date, publish_date (+45 days), net_income, gross_profit, total_assets, total_equity, shares."""
    money = F.col("l_extendedprice").cast("decimal(18,2)")
    disc, tax = F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    quarter = F.last_day(F.add_months(F.trunc(F.col("l_shipdate").cast("date"), "quarter"), 2))
    q = (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), quarter.alias("report_date"))
        .agg(F.sum(money * (1 - disc)).cast("double").alias("revenue"), F.sum(money * (1 - disc - tax)).cast("double").alias("gross_profit"), F.sum("l_quantity").alias("qty"))
    )
    w = Window.partitionBy("ticker").orderBy("report_date").rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumns({"total_assets": F.sum("revenue").over(w), "shares": F.sum("qty").over(w), "net_income": F.col("gross_profit") * 0.5})
    return q.select("ticker", "report_date", F.date_add("report_date", 45).alias("publish_date"), "revenue", "net_income", "gross_profit", "total_assets", (F.col("total_assets") * 0.6).alias("total_equity"), "shares")


def market(panel: DataFrame) -> DataFrame:
    """date and the equal-weight mean return of the date."""
    return panel.groupBy("date").agg(F.avg("ret").alias("mkt"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as quotes: symbol, ts, price."""
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))
