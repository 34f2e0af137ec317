"""Portfolio construction: schedules, selections, weights, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from .evaluation import rank_bin


def rebalance_dates(dates: DataFrame, frequency: str = "M") -> DataFrame:
    """The last session of each day, ISO week or month."""
    unit = {"D": F.col("date"), "W": F.trunc("date", "week"), "M": F.trunc("date", "month")}[frequency]
    return dates.select("date").distinct().groupBy(unit.alias("_u")).agg(F.max("date").alias("date")).select("date")


def quantile_sides(signal: DataFrame, x: str, q: int = 5, short: bool = True) -> DataFrame:
    """side 1 for the top bin by rank and -1 for the bottom one."""
    w = Window.partitionBy("date").orderBy(x, "ticker")
    d = signal.filter(F.col(x).isNotNull()).withColumn("bin", rank_bin(F.row_number().over(w), F.count("*").over(W.by_date()), q))
    side = F.when(F.col("bin") == q, 1).when((F.col("bin") == 1) & F.lit(short), -1)
    return d.withColumn("side", side).filter("side is not null")


def top_n(signal: DataFrame, x: str, n: int, short: bool = False) -> DataFrame:
    d = signal.filter(F.col(x).isNotNull())
    hi = F.row_number().over(Window.partitionBy("date").orderBy(F.col(x).desc(), "ticker"))
    lo = F.row_number().over(Window.partitionBy("date").orderBy(F.col(x), "ticker"))
    d = d.withColumns({"_h": hi, "_l": lo})
    side = F.when(F.col("_h") <= n, 1).when((F.col("_l") <= n) & F.lit(short), -1)
    return d.withColumn("side", side).filter("side is not null").drop("_h", "_l")


def weigh(sides: DataFrame, by: Column | None = None) -> DataFrame:
    """weight: each side's names in proportion to ``by`` (equal if none); a side sums to 1 or -1."""
    raw = F.lit(1.0) if by is None else by
    total = F.sum(raw).over(Window.partitionBy("date", "side"))
    return sides.withColumn("weight", F.coalesce(W.div(raw, total), F.lit(0.0)) * F.col("side"))


def cap_weight(x: str) -> Column:
    """Market value with missing ones at the side's median and a floor of 1."""
    return F.greatest(F.coalesce(x, F.percentile(x, F.lit(0.5)).over(Window.partitionBy("date", "side"))), F.lit(1.0))


def inverse_volatility(panel: DataFrame, n: int = 63, least: int = 20) -> DataFrame:
    """panel with vol, the annualised deviation of the last n returns."""
    return panel.withColumn("vol", W.roll(F.stddev_samp, F.col("ret"), n, least) * F.sqrt(F.lit(252.0)))


def normalise(w: DataFrame, long_only: bool = True) -> DataFrame:
    x = F.col("weight")
    if long_only:
        x = F.greatest(x, F.lit(0.0))
        return w.withColumn("weight", F.coalesce(W.div(x, F.sum(x).over(W.by_date())), F.lit(0.0)))
    up, down = F.greatest(x, F.lit(0.0)), F.greatest(-x, F.lit(0.0))
    legs = F.when(x > 0, W.div(x, F.sum(up).over(W.by_date()))).when(x < 0, W.div(x, F.sum(down).over(W.by_date())))
    return w.withColumn("weight", F.coalesce(legs, F.lit(0.0)))


def clip_names(w: DataFrame, low: float, high: float) -> DataFrame:
    x = F.col("weight")
    return w.withColumn("weight", F.when(x >= 0, F.least(F.greatest(x, F.lit(low)), F.lit(high))).otherwise(-F.least(F.greatest(-x, F.lit(low)), F.lit(high))))


def clip_sectors(w: DataFrame, cap: float) -> DataFrame:
    """Scale sectors whose gross weight passes the cap; names without a sector stay."""
    gross = F.sum(F.abs("weight")).over(Window.partitionBy("date", "sector"))
    return w.withColumn("weight", F.when(F.col("sector").isNotNull() & (gross > cap), F.col("weight") * cap / F.nullif(gross, F.lit(0.0))).otherwise(F.col("weight")))


def constrain(w: DataFrame, low: float = 0.0, high: float = 0.1, sector_cap: float = 0.4, long_only: bool = True) -> DataFrame:
    """Name caps, sector caps, renormalisation, and no weights of 1e-10 or less.  Caps may be passed again by the last step."""
    d = normalise(clip_sectors(clip_names(w, low, high), sector_cap), long_only)
    return d.filter(F.abs("weight") > 1e-10)


def clip_turnover(w: DataFrame, most: float) -> DataFrame:
    """Blend each date's weights with the last date's final ones where turnover would pass ``most``.

    Final weights depend on the dates before, so the rebalance dates (a few
    hundred rows a name at most) go through one fold per portfolio.
    """
    import pandas as pd

    def run(pdf):
        prev, out = pd.Series(dtype=float), []
        for date, g in pdf.sort_values("date").groupby("date"):
            cur = g.set_index("ticker")["weight"]
            both = cur.index.union(prev.index)
            a, b = cur.reindex(both).fillna(0.0), prev.reindex(both).fillna(0.0)
            t = (a - b).abs().sum() / 2
            if len(prev) and t > most:
                a = b + (a - b) * (most / t)
            prev = a[a.abs() > 1e-10]
            out.append(pd.DataFrame({"date": date, "ticker": prev.index, "weight": prev.to_numpy()}))
        return pd.concat(out) if out else pdf[["date", "ticker", "weight"]].head(0)

    return w.select("date", "ticker", "weight", F.lit(1).alias("_p")).groupBy("_p").applyInPandas(run, "date date, ticker string, weight double")


def carry_forward(w: DataFrame, sessions: DataFrame) -> DataFrame:
    """Daily weights: each session takes those of the latest rebalance; a session-to-rebalance map and one equi-join."""
    s = sessions.select("date").distinct().withColumn("reb", F.lit(None).cast("date"))
    r = w.select("date").distinct().withColumn("reb", F.col("date"))
    order = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    pairs = s.join(r.select("date", F.col("reb").alias("_r")), "date", "left").withColumn("reb", F.last("_r", ignorenulls=True).over(order)).filter("reb is not null")
    return pairs.select("date", "reb").join(w.withColumnRenamed("date", "reb"), "reb").drop("reb").filter(F.abs("weight") > 1e-10)


def violations(w: DataFrame, long_only: bool = True, gross: float = 2.0) -> DataFrame:
    """Dates whose weights break a rule, with the sums."""
    d = w.groupBy("date").agg(F.sum("weight").alias("net"), F.sum(F.abs("weight")).alias("gross"), F.min("weight").alias("least"))
    bad = (F.abs(F.col("net") - 1) > 1e-6) | (F.col("least") < -1e-10) if long_only else F.col("gross") > gross + 1e-6
    return d.filter(bad)


def changes(w: DataFrame) -> DataFrame:
    """weight_from and weight_to of every name at every rebalance (names of this date or the one before)."""
    order = w.select("date").distinct().select("date", F.lead("date").over(Window.orderBy("date")).alias("next"))  # one row a date
    now = w.select("date", "ticker", F.col("weight").alias("weight_to"))
    old = w.join(F.broadcast(order.filter("next is not null")), "date").select(F.col("next").alias("date"), "ticker", F.col("weight").alias("weight_from"))
    d = now.join(old, ["date", "ticker"], "full_outer")
    return d.select("date", "ticker", F.coalesce("weight_from", F.lit(0.0)).alias("weight_from"), F.coalesce("weight_to", F.lit(0.0)).alias("weight_to"))


def turnover(w: DataFrame) -> DataFrame:
    d = changes(w)
    return d.groupBy("date").agg((F.sum(F.abs(F.col("weight_to") - F.col("weight_from"))) / 2).alias("turnover"))


def regime_exposure(w: DataFrame, exposure: DataFrame) -> DataFrame:
    """Weights times the date's net exposure (1 where there is none)."""
    return w.join(F.broadcast(exposure), "date", "left").withColumn("weight", F.col("weight") * F.coalesce("net_exposure", F.lit(1.0))).drop("net_exposure")
