"""Value and quality factors from point-in-time fundamentals.

A report is known from the first session after its publication date on; each
bar sees the latest known report of its ticker (a backward as-of join, done as
a union ordered by date and a forward fill: no range join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W

FACTORS = ("EARNINGS_YIELD", "BOOK_TO_MARKET", "GROSS_PROFITABILITY", "ASSET_GROWTH")


def trailing(f: DataFrame, column: str, name: str) -> DataFrame:
    """Sum of the last four reports, or the latest one where there are fewer."""
    w = Window.partitionBy("ticker").orderBy("report_date").rowsBetween(-3, 0)
    return f.withColumn(name, F.when(F.count(column).over(w) >= 4, F.sum(column).over(w)).otherwise(F.last(column, ignorenulls=True).over(w)))


def year_ago(f: DataFrame, column: str, name: str, tolerance: int = 120) -> DataFrame:
    """The value of the report nearest to a year before (within ``tolerance`` days, the earlier one on a tie)."""
    goal = F.date_sub("report_date", 365)
    a = f.select("ticker", "report_date", goal.alias("_goal"))
    # Reports are matched by month bucket, so the join is an equi-join.
    months = F.explode(F.sequence(F.trunc(F.date_sub("_goal", tolerance), "month"), F.trunc(F.date_add("_goal", tolerance), "month"), F.expr("interval 1 month")))
    other = f.select("ticker", F.trunc("report_date", "month").alias("_m"), F.col("report_date").alias("_r"), F.col(column).alias("_v"))
    near = a.withColumn("_m", months).join(other, ["ticker", "_m"])
    gap = F.abs(F.datediff("_r", "_goal"))
    near = near.filter((gap <= tolerance) & (F.col("_r") < F.col("report_date")))
    near = near.groupBy("ticker", "report_date").agg(F.min_by("_v", F.struct(gap, "_r")).alias(name))
    return f.join(near, ["ticker", "report_date"], "left")


def as_of(bars: DataFrame, reports: DataFrame, columns: list[str], known: str = "publish_date") -> DataFrame:
    """bars with the columns of the latest report whose ``known`` date lies before the bar's."""
    r = reports.select("ticker", F.date_add(known, 1).alias("date"), F.struct(*columns).alias("_r"), F.lit(0).alias("_o"))
    b = bars.withColumns({"_r": F.lit(None).cast(r.schema["_r"].dataType), "_o": F.lit(1)})
    w = Window.partitionBy("ticker").orderBy("date", "_o").rowsBetween(Window.unboundedPreceding, 0)
    d = b.unionByName(r, allowMissingColumns=True).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_o = 1")
    return d.select(*bars.columns, "_r.*")


def compute(bars: DataFrame, f: DataFrame, name: str, lag: int = 1) -> DataFrame:
    """date, ticker and value of one factor, lagged."""
    if name == "ASSET_GROWTH":
        f = year_ago(f, "total_assets", "_prior").withColumn("raw", W.div(F.col("total_assets"), F.col("_prior")) - 1)
        d = as_of(bars, f, ["raw"])
    else:
        f = trailing(trailing(f, "net_income", "ttm_ni"), "gross_profit", "ttm_gp")
        d = as_of(bars, f, ["ttm_ni", "ttm_gp", "total_assets", "total_equity", "shares"])
        cap = F.col("shares") * F.col("close")
        raw = {"EARNINGS_YIELD": W.div(F.col("ttm_ni"), cap), "BOOK_TO_MARKET": W.div(F.col("total_equity"), cap), "GROSS_PROFITABILITY": W.div(F.col("ttm_gp"), F.col("total_assets"))}[name]
        d = d.withColumn("raw", raw)
    return d.select("date", "ticker", F.lag("raw", lag).over(W.by_ticker()).alias("value"))
