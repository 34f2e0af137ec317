"""Calendar membership, statements ready for point-in-time use, cleaning of suspended names, market rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W


@dataclass(frozen=True)
class MarketRules:
    exchanges: tuple[str, ...]
    settlement_days: int
    lot: int
    short_selling: bool
    limits: tuple[tuple[str, float], ...] = ()
    stamp_tax: float = 0.0
    currency: str = "USD"


# Fixed values of the two markets.
RULES = {
    "cn": MarketRules(("XSHG", "XSHE"), 1, 100, False, (("main_board", 0.10), ("star_market", 0.20)), 0.0005, "CNY"),
    "us": MarketRules(("XNYS",), 2, 1, True),
}


def lots(shares: Column, market: str) -> Column:
    """Column: shares rounded down to whole lots of a market."""
    return F.floor(shares / RULES[market].lot).cast("long") * RULES[market].lot


def is_session(dates: DataFrame, calendar: DataFrame, x: str = "date") -> DataFrame:
    """dates with is_session: whether x is in the calendar."""
    c = calendar.select(F.col("date").alias(x), F.lit(True).alias("is_session")).distinct()
    return dates.join(c, x, "left").withColumn("is_session", F.coalesce("is_session", F.lit(False)))


def previous_session(dates: DataFrame, calendar: DataFrame, x: str = "date") -> DataFrame:
    """dates with the last session strictly before x (null before the first); a calendar has one row a session."""
    c = calendar.select(F.col("date").alias(x), F.lit(2).alias("_c"), F.col("date").alias("_d")).distinct()
    d = dates.select(x).distinct().withColumns({"_c": F.lit(1), "_d": F.lit(None).cast("date")})
    order = Window.orderBy(x, "_c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = c.unionByName(d).withColumn("prev", F.last("_d", ignorenulls=True).over(order)).filter("_c = 1").select(x, "prev")
    return dates.join(u, x, "left")


def align_inner(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """The rows of df on sessions."""
    return df.join(calendar.select("date").distinct(), "date", "left_semi")


def available(statements: DataFrame, calendar: DataFrame, lag: int = 1) -> DataFrame:
    """statements with date: the first session after publish_date + lag days (null beyond the last session)."""
    from .data import next_session

    d = statements.withColumn("_at", F.date_add("publish_date", lag))
    return next_session(d, calendar, "_at").withColumnRenamed("next", "date").drop("_at")


def merge_statements(*parts: DataFrame) -> DataFrame:
    """Full outer join of statements on ticker, report_date and publish_date."""
    keys = ["ticker", "report_date", "publish_date"]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys, "full")
    return out


def fill_market_cap(d: DataFrame) -> DataFrame:
    """market_cap where it is known, else shares times close; book value per share; typed nulls for columns not there."""
    known = F.col("market_cap") if "market_cap" in d.columns else F.lit(None).cast("double")
    equity = F.col("total_equity") if "total_equity" in d.columns else F.lit(None).cast("double")
    return d.withColumns({"market_cap": F.coalesce(known, F.col("shares") * F.col("close")), "book_per_share": W.div(equity, F.col("shares"))})


def cap_grid(tickers: DataFrame, dates: DataFrame, shares: DataFrame) -> DataFrame:
    """Every ticker on every date with its shares as the only field: what stands in where statements are missing."""
    return dates.select("date").distinct().crossJoin(tickers.select("ticker").distinct()).join(shares.select("ticker", "shares"), "ticker", "left")


def clean_suspended(d: DataFrame, fields: tuple[str, ...] = ("close", "high", "low")) -> DataFrame:
    """Prices of zero or none take the ticker's last good ones; suspended rows have no volume and no amount."""
    out = {f: W.forward_fill(F.nullif(F.col(f), F.lit(0.0))) for f in fields}
    off = F.col("is_suspended")
    return d.withColumns(out | {x: F.when(off, F.lit(0.0)).otherwise(F.col(x)) for x in ("volume", "amount")})


def new_listing(d: DataFrame, days: int = 60) -> DataFrame:
    """is_new: within ``days`` days of the ticker's first row."""
    first = F.min("date").over(Window.partitionBy("ticker"))
    return d.withColumn("is_new", F.col("date") < F.date_add(first, days))


def traded_returns(d: DataFrame) -> DataFrame:
    """ret and log_ret from the ticker's last row, zero on suspended rows."""
    change = W.div(F.col("close"), W.lag(F.col("close")))
    off = F.col("is_suspended")
    return d.withColumns({"ret": F.when(off, 0.0).otherwise(change - 1), "log_ret": F.when(off, 0.0).otherwise(F.log(F.when(change > 0, change)))})
