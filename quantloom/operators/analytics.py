"""Risk, benchmark and robustness analytics of return series, and walk-forward folds."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W


def risk_summary(r: DataFrame, x: str = "ret", confidence: float = 0.95) -> DataFrame:
    """Historical, parametric and Cornish-Fisher value at risk, and the expected shortfall; null below 10 returns."""
    z = NormalDist().inv_cdf(1 - confidence)
    v = F.col(x)
    n = F.count(v)
    s, k = W.unbiased_skew(F.skewness(v), n), W.unbiased_kurtosis(F.kurtosis(v), n)
    zc = z + (z * z - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s * s / 36
    q = r.agg(F.percentile(v, F.lit(1 - confidence)).alias("_q"))  # one row
    out = r.crossJoin(F.broadcast(q)).agg(
        n.alias("n"), F.greatest(F.lit(0.0), -F.first("_q")).alias("var_hist"), F.greatest(F.lit(0.0), -F.avg(F.when(v <= F.least(F.col("_q"), F.lit(0.0)), v))).alias("cvar_hist"),
        F.greatest(F.lit(0.0), -(F.avg(v) + F.stddev_samp(v) * z)).alias("var_normal"), F.greatest(F.lit(0.0), -(F.avg(v) + F.stddev_samp(v) * zc)).alias("var_cornish"),
    )
    return out.select("n", *[F.when(F.col("n") >= 10, F.col(c)).alias(c) for c in out.columns if c != "n"])


def rolling_var(r: DataFrame, x: str = "ret", n: int = 252, least: int = 126, confidence: float = 0.95) -> DataFrame:
    w = Window.orderBy("date").rowsBetween(1 - n, 0)
    return r.withColumn("var", F.when(F.count(x).over(w) >= least, F.greatest(F.lit(0.0), -F.percentile(x, F.lit(1 - confidence)).over(w))))


def kupiec(breaches: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """(likelihood ratio, p-value) of a count of breaches."""
    p, k = 1 - confidence, breaches
    if n == 0:
        return 0.0, 1.0
    q = k / n
    ll = lambda a: (n - k) * math.log(max(1 - a, 1e-300)) + k * math.log(max(a, 1e-300))
    lr = max(0.0, -2 * (ll(p) - ll(q)))
    return lr, math.erfc(math.sqrt(lr / 2))


def benchmark_stats(d: DataFrame, x: str = "ret", m: str = "mkt", rf: float = 0.0) -> DataFrame:
    """Alpha and beta with errors, R2, tracking error, information ratio and Treynor ratio over dates with both."""
    daily = (1 + rf) ** (1 / 252) - 1
    d = d.filter(F.col(x).isNotNull() & F.col(m).isNotNull()).select((F.col(x) - daily).alias("y"), (F.col(m) - daily).alias("v"))
    n = F.count("y")
    sse = F.regr_syy("y", "v") * (1 - F.regr_r2("y", "v"))
    a = d.agg(
        n.alias("n"), F.regr_slope("y", "v").alias("beta"), F.regr_intercept("y", "v").alias("alpha"), F.regr_r2("y", "v").alias("r2"), F.avg("v").alias("_mv"), F.var_samp("v").alias("_vv"),
        W.div(sse, n - 2).alias("_s2"), (F.stddev_samp(F.col("y") - F.col("v")) * math.sqrt(252)).alias("tracking_error"), (F.avg(F.col("y") - F.col("v")) * 252).alias("active_return"), (F.avg("y") * 252).alias("_ey"),
    )
    se_b = F.sqrt(W.div(F.col("_s2"), F.col("n") * F.col("_vv")))
    se_a = F.sqrt(F.col("_s2") * (W.div(F.lit(1.0), F.col("n")) + W.div(F.col("_mv") * F.col("_mv"), F.col("n") * F.col("_vv"))))
    return a.select(
        "n", "beta", "alpha", "r2", W.div(F.col("alpha"), se_a).alias("t_alpha"), W.div(F.col("beta"), se_b).alias("t_beta"), "tracking_error", "active_return",
        W.div(F.col("active_return"), F.col("tracking_error")).alias("information_ratio"), W.div(F.col("_ey"), F.col("beta")).alias("treynor"), (F.sqrt("_s2") * math.sqrt(252)).alias("residual_vol"),
    )


def student_p(t: float, df: int) -> float:
    """Two-sided p-value of Student's t by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(1 - x, b, a)
    return _beta(x, a, b)


def _beta(x: float, a: float, b: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / (c or 1e-300)
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def rolling_benchmark(d: DataFrame, n: int = 252) -> DataFrame:
    w = Window.orderBy("date").rowsBetween(1 - n, 0)
    full = F.count("*").over(w) == n
    return d.withColumns({"beta": F.when(full, F.regr_slope("ret", "mkt").over(w)), "alpha": F.when(full, F.regr_intercept("ret", "mkt").over(w)), "r2": F.when(full, F.regr_r2("ret", "mkt").over(w))})


def sector_exposure(w: DataFrame) -> DataFrame:
    x = F.col("weight")
    return w.groupBy("date", "sector").agg(F.sum(F.greatest(x, F.lit(0.0))).alias("long"), F.sum(F.least(x, F.lit(0.0))).alias("short"), F.sum(x).alias("net"), F.count("*").alias("n"))


def rolling_sharpe(r: DataFrame, x: str = "ret", n: int = 252, least: int = 126) -> DataFrame:
    w = Window.orderBy("date").rowsBetween(1 - n, 0)
    return r.withColumn("sharpe", F.when(F.count(x).over(w) >= least, W.div(F.avg(x).over(w), F.stddev_samp(x).over(w)) * math.sqrt(252)))


def periodic_returns(r: DataFrame, x: str = "ret", unit: str = "month") -> DataFrame:
    return r.groupBy(F.trunc("date", unit).alias("period")).agg((F.product(1 + F.coalesce(x, F.lit(0.0))) - 1).alias("ret"), F.count("*").alias("n"))


def month_table(r: DataFrame, x: str = "ret") -> DataFrame:
    d = r.withColumns({"year": F.year("date"), "m": F.month("date")})
    return d.groupBy("year").pivot("m", list(range(1, 13))).agg(F.product(1 + F.coalesce(x, F.lit(0.0))) - 1).select("year", *[F.col(str(i)).alias(f"m{i:02d}") for i in range(1, 13)])


def crowding(w: DataFrame, factors: DataFrame, names: list[str]) -> DataFrame:
    """Sum of weight times factor by date and factor."""
    long = factors.unpivot(["date", "ticker"], names, "factor", "value")
    return w.join(long, ["date", "ticker"]).groupBy("date", "factor").agg(F.sum(F.col("weight") * F.col("value")).alias("exposure"))


def deflated_sharpe(sharpe: float, trials: int, n: int, skew: float = 0.0, kurt: float = 0.0) -> float:
    """Probability that a per-period Sharpe ratio beats the best of ``trials`` without skill."""
    norm = NormalDist()
    se = math.sqrt(max(1e-12, (1 - skew * sharpe + (kurt + 2) / 4 * sharpe * sharpe) / max(n - 1, 1)))
    goal = norm.inv_cdf(1 - 1 / max(trials, 2)) * se
    return norm.cdf((sharpe - goal) / se)


def overfit_probability(r: DataFrame) -> DataFrame:
    """Is the best series of the first half below the median in the second?  r: date, name, ret; null below 40 dates."""
    dates = r.select("date").distinct()
    halves = dates.withColumn("half", F.ntile(2).over(Window.orderBy("date")))
    s = r.join(F.broadcast(halves), "date").groupBy("name", "half").agg(W.div(F.avg("ret"), F.stddev_samp("ret")).alias("s"))
    both = s.groupBy("name").pivot("half", [1, 2]).agg(F.first("s")).select("name", F.col("1").alias("a"), F.col("2").alias("b"))
    return both.agg(F.max_by("name", F.struct("a", "name")).alias("best"), (F.max_by("b", F.struct("a", "name")) < F.percentile("b", F.lit(0.5))).cast("double").alias("overfit"), F.count("*").alias("n"))


def folds(dates: DataFrame, train: int = 36, test: int = 12, step: int = 12) -> DataFrame:
    """fold, train_start, train_end, test_end by month offsets from the first date; half-open spans."""
    d = dates.agg(F.trunc(F.min("date"), "month").alias("lo"), F.max("date").alias("hi"))
    last = F.floor((F.months_between("hi", "lo") - train) / step)
    d = d.filter(last >= 0).select("hi", "lo", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("fold"))
    return d.select("fold", F.add_months("lo", F.col("fold") * step).alias("train_start"), F.add_months("lo", F.col("fold") * step + train).alias("train_end"), F.add_months("lo", F.col("fold") * step + train + test).alias("test_end"))


def fold_ic(ic: DataFrame, fold_table: DataFrame) -> DataFrame:
    """Mean IC in the training and the test span of every fold; the fold table is a few rows."""
    f = F.broadcast(fold_table)
    d = ic.join(f, (ic["date"] >= f["train_start"]) & (ic["date"] < f["test_end"]))
    part = F.when(F.col("date") < F.col("train_end"), "train").otherwise("test")
    return d.groupBy("fold", part.alias("part")).agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("n"))
