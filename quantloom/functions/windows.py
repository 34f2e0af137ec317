"""Column builders over the two windows of a panel: a ticker's rows by date, and a date's cross-section.

Missing values are NULL everywhere; division by zero gives NULL (ANSI mode is on).
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


def by_date():
    return Window.partitionBy("date")


def to_date():
    return by_ticker().rowsBetween(Window.unboundedPreceding, 0)


def last_rows(n: int):
    """The current row and the n - 1 before it."""
    return by_ticker().rowsBetween(1 - n, 0)


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def lag(x: Column, k: int = 1) -> Column:
    return F.lag(x, k).over(by_ticker())


def lead(x: Column, k: int = 1) -> Column:
    return F.lead(x, k).over(by_ticker())


def pct_change(x: Column, k: int) -> Column:
    return div(x, lag(x, k)) - 1


def roll(agg, x: Column, n: int, least: int) -> Column:
    """agg over the last n rows if at least ``least`` of them are not null."""
    w = last_rows(n)
    return F.when(F.count(x).over(w) >= least, agg(x).over(w))


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def forward_fill(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(to_date())


def backward_fill(x: Column) -> Column:
    return F.first(x, ignorenulls=True).over(by_ticker().rowsBetween(0, Window.unboundedFollowing))


def rank_average(x: Column, *by: str) -> Column:
    """Average rank of x within the groups, nulls last and not ranked."""
    return F.when(x.isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(x.asc_nulls_last())) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2)


def rank_pct(x: Column, *by: str) -> Column:
    return rank_average(x, *by) / F.count(x).over(Window.partitionBy(*by))


def zscore(x: Column, *by: str) -> Column:
    """(x - mean) / sample standard deviation; 0 where that is zero or undefined."""
    w = Window.partitionBy(*by)
    sd = F.stddev_samp(x).over(w)
    return F.when(x.isNotNull(), F.coalesce(div(x - F.avg(x).over(w), F.when(sd > 0, sd)), F.lit(0.0)))


def unbiased_skew(g1: Column, n: Column) -> Column:
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def unbiased_kurtosis(g2: Column, n: Column) -> Column:
    return F.when(n >= 4, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * g2 + 6))


def corr(x: Column, y: Column) -> Column:
    """Pearson correlation aggregate over pairs without nulls; NULL for constant input."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return div(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
