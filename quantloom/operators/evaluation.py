"""Factor evaluation: information coefficients, quantiles, turnover, stability."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W

#: Correlations up to this are zero but for rounding.
TINY = 1e-12


def forward_returns(panel: DataFrame, horizons: tuple[int, ...] = (1, 5, 10, 20), price: str = "close") -> DataFrame:
    return panel.withColumns({f"fwd_{h}": W.div(W.lead(F.col(price), h), F.col(price)) - 1 for h in horizons})


def ic_series(df: DataFrame, x: str, y: str, ranked: bool = True, least: int = 5, by: tuple = ("date",)) -> DataFrame:
    """n and ic per date (Spearman if ranked, else Pearson) over rows with both values; null below ``least`` pairs."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    if ranked:
        d = d.withColumns({"_x": W.rank_average(F.col("_x"), *by), "_y": W.rank_average(F.col("_y"), *by)})
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, W.corr(F.col("_x"), F.col("_y"))).alias("ic"))


def ic_summary(ic: DataFrame, by: tuple = ()) -> DataFrame:
    """mean, std, icir (annualised), t, hit rate, skewness, kurtosis and number of periods."""
    v = F.col("ic")
    n, sd = F.count(v), F.stddev_samp(v)
    return ic.groupBy(*by).agg(
        F.avg(v).alias("mean_ic"), sd.alias("std_ic"), (W.div(F.avg(v), sd) * math.sqrt(252)).alias("icir"), (W.div(F.avg(v), sd) * F.sqrt(n)).alias("t_stat"),
        F.avg((v > TINY).cast("double")).alias("hit_rate"), W.unbiased_skew(F.skewness(v), n).alias("skew"), W.unbiased_kurtosis(F.kurtosis(v), n).alias("kurt"), n.alias("n"),
    )


def p_value(t: float | None) -> float | None:
    """Two-sided normal p-value of a t statistic."""
    return None if t is None else math.erfc(abs(t) / math.sqrt(2))


def ic_decay(df: DataFrame, x: str, horizons: tuple[int, ...]) -> DataFrame:
    """Rank IC mean and ICIR by horizon; all horizons in one pass over the long frame."""
    d = forward_returns(df, horizons).unpivot(["date", "ticker", x], [f"fwd_{h}" for h in horizons], "h", "fwd")
    d = d.withColumn("h", F.substring("h", 5, 9).cast("int"))
    return ic_summary(ic_series(d, x, "fwd", by=("h", "date")), ("h",)).select("h", "mean_ic", "icir", "n")


def quantile_bin(x, q: int, *by: str):
    """Column: bin 1..q by linear quantile edges, right-closed, equal edges merged."""
    edges = F.percentile(x, F.array(*[F.lit(i / q) for i in range(1, q)])).over(Window.partitionBy(*by))
    return F.when(x.isNotNull(), F.size(F.filter(F.array_distinct(edges), lambda e: e < x)) + 1)


def rank_bin(rn, n, q: int):
    """Column: bin of row number rn of n rows cut into q by rank."""
    return F.greatest(F.lit(1), F.ceil(W.div((rn - 1) * q, F.nullif(n - 1, F.lit(0))))).cast("int")


def quantile_returns(df: DataFrame, x: str, y: str, q: int = 5) -> DataFrame:
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.withColumn("bin", quantile_bin(F.col(x), q, "date"))
    return d.groupBy("date", "bin").agg(F.avg(y).alias("ret"), F.count("*").alias("n"))


def long_short(bins: DataFrame, q: int = 5) -> DataFrame:
    top, low = F.max(F.when(F.col("bin") == q, F.col("ret"))), F.max(F.when(F.col("bin") == 1, F.col("ret")))
    return bins.groupBy("date").agg((top - low).alias("ls"))


def turnover(df: DataFrame, x: str, least: int = 5) -> DataFrame:
    """1 - rank correlation of each date's names with the date before, over the names in both."""
    d = df.filter(F.col(x).isNotNull()).select("date", "ticker", F.col(x).alias("v"))
    order = d.select("date").distinct().select("date", F.lag("date").over(Window.orderBy("date")).alias("prev"))  # one row a date
    now = d.join(F.broadcast(order.filter("prev is not null")), "date")
    both = now.join(d.select(F.col("date").alias("prev"), "ticker", F.col("v").alias("u")), ["prev", "ticker"])
    return ic_series(both, "v", "u", least=least).select("date", "n", (1 - F.col("ic")).alias("turnover"))


def monotonicity(bins: DataFrame) -> DataFrame:
    """Rank correlation of bin and mean return over all dates; null below 3 bins."""
    m = bins.groupBy("bin").agg(F.avg("ret").alias("ret")).withColumn("g", F.lit(1))
    return ic_series(m, "bin", "ret", least=3, by=("g",)).select("n", F.col("ic").alias("monotonicity"))


def stability(ic: DataFrame, chunks: int = 3) -> DataFrame:
    """Mean and share of positive IC in consecutive chunks of dates, the first ones longer."""
    d = ic.withColumn("chunk", F.ntile(chunks).over(Window.orderBy("date")))  # one row a date
    return d.groupBy("chunk").agg(F.avg("ic").alias("mean_ic"), F.avg((F.col("ic") > TINY).cast("double")).alias("hit_rate"), F.count("*").alias("n"))


def capacity(df: DataFrame, x: str, dollar: str, q: int = 5, share: float = 0.1) -> DataFrame:
    """Per date: share of the dollar volume of the top 1/q of names."""
    cut = df.filter(F.col(x).isNotNull()).withColumn("_q", F.percentile(x, F.lit(1 - 1 / q)).over(W.by_date()))
    return cut.filter(F.col(x) >= F.col("_q")).groupBy("date").agg((share * F.sum(dollar)).alias("capacity"), F.count("*").alias("n"))


def market_split(ic: DataFrame, mkt: DataFrame) -> DataFrame:
    """Mean IC on dates with a market return at or above its median, and below."""
    d = ic.join(mkt, "date")
    d = d.crossJoin(F.broadcast(mkt.agg(F.percentile("mkt", F.lit(0.5)).alias("_m"))))  # one row
    return d.groupBy((F.col("mkt") >= F.col("_m")).alias("up")).agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("n"))
