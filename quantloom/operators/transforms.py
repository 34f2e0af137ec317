"""Cross-sectional transforms of a signal and the effective signal.

Each function takes a frame with date, ticker and a named column and returns it
with the column replaced.  Statistics of a date come from windows over the
date, so consecutive transforms share one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W


def apply_lag(df: DataFrame, x: str, k: int = 1) -> DataFrame:
    return df.withColumn(x, F.lag(x, k).over(W.by_ticker()))


def finite(x: str):
    """Column: NULL for NaN and infinities."""
    c = F.col(x).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def handle_missing(df: DataFrame, x: str, method: str = "drop", by: tuple = ("date",)) -> DataFrame:
    df = df.withColumn(x, finite(x))
    if method == "drop":
        return df.filter(F.col(x).isNotNull())
    if method == "zero":
        return df.withColumn(x, F.coalesce(x, F.lit(0.0)))
    if method == "median":
        return df.withColumn(x, F.coalesce(x, F.percentile(x, F.lit(0.5)).over(Window.partitionBy(*by))))
    raise ValueError(f"unknown method {method!r}")


def winsorize(df: DataFrame, x: str, low: float = 0.01, high: float = 0.99, by: tuple = ("date",)) -> DataFrame:
    """Clip to the group's quantiles; they are summed by group and joined, not kept in every row's window."""
    q = df.groupBy(*by).agg(F.percentile(x, F.array(F.lit(low), F.lit(high))).alias("_q"))
    clipped = F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.get("_q", 0)), F.get("_q", 1)))
    return df.join(q, list(by), "left").withColumn(x, clipped).drop("_q")


def zscore(df: DataFrame, x: str, by: tuple = ("date",)) -> DataFrame:
    return df.withColumn(x, W.zscore(F.col(x), *by))


def rank(df: DataFrame, x: str, by: tuple = ("date",)) -> DataFrame:
    return df.withColumn(x, W.rank_pct(F.col(x), *by))


def neutralize_group(df: DataFrame, x: str, group: str, by: tuple = ("date",)) -> DataFrame:
    return df.withColumn(x, F.col(x) - F.avg(x).over(Window.partitionBy(*by, group)))


def neutralize_linear(df: DataFrame, x: str, z: str, by: tuple = ("date",)) -> DataFrame:
    """Residual of the date's regression of x on z; fewer than 3 pairs: unchanged; constant z: demeaned; no pair: null."""
    w = Window.partitionBy(*by)
    both = F.col(x).isNotNull() & F.col(z).isNotNull()
    y, v = F.when(both, F.col(x)), F.when(both, F.col(z))
    n, beta = F.count(y).over(w), F.regr_slope(y, v).over(w)
    mean_y, mean_v = F.avg(y).over(w), F.avg(v).over(w)
    return df.withColumn(x, F.when(n < 3, F.col(x)).when(both, y - mean_y - F.coalesce(beta, F.lit(0.0)) * (v - mean_v)))


def effective_signal(df: DataFrame, x: str, direction: int = 1, missing: str = "drop", groups: tuple = (), linear: tuple = (), ranked: bool = True, by: tuple = ("date",)) -> DataFrame:
    """Direction, missing values, winsorizing, neutralisation, z-score and rank, in this order."""
    df = df.withColumn(x, F.col(x) * (-1 if direction < 0 else 1))
    df = winsorize(handle_missing(df, x, missing, by), x, by=by)
    for g in groups:
        df = neutralize_group(df, x, g, by)
    for z in linear:
        df = neutralize_linear(df, x, z, by)
    df = zscore(df, x, by)
    return rank(df, x, by) if ranked else df


def effective_frame(df: DataFrame, directions: dict[str, int], ranked: bool = True) -> DataFrame:
    """The effective signal of many factor columns at once, long: date, ticker, factor, value."""
    long = df.unpivot(["date", "ticker"], list(directions), "factor", "value")
    flip = F.create_map(*[F.lit(v) for kv in directions.items() for v in kv])
    long = long.withColumn("value", F.col("value") * F.try_element_at(flip, F.col("factor")))
    return effective_signal(long, "value", ranked=ranked, by=("date", "factor"))
