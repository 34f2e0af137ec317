"""Scorecards of signals: cross-sectional, time-series, regime and relative-value; tear sheets, tests of many factors at once.

Frames are long: date, ticker, factor, value, and forward returns fwd_<h>.  All
factors and horizons go through one plan; nothing is collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from . import evaluation as E

YEAR = math.sqrt(252)


def sharpe(x: str, per_year: float = 252.0) -> Column:
    """Aggregate: annualised mean over deviation, null where that is zero."""
    return W.div(F.avg(x), F.nullif(F.stddev_samp(x), F.lit(0.0))) * math.sqrt(per_year)


def top_change(d: DataFrame, x: str = "x") -> DataFrame:
    """date, turnover: names that entered or left the top fifth since the last date, over the names that were in it."""
    cut = F.percentile(x, F.lit(0.8)).over(W.by_date())
    top = d.withColumn("_c", cut).filter(F.col(x) >= F.col("_c")).select("date", "ticker")
    order = top.groupBy("date").agg(F.count("*").alias("n")).select("date", "n", F.lag("date").over(Window.orderBy("date")).alias("prev"), F.lag("n").over(Window.orderBy("date")).alias("was"))  # one row a date
    both = top.join(order.filter("prev is not null").select("date", "prev"), "date").join(top.select(F.col("date").alias("prev"), "ticker"), ["prev", "ticker"]).groupBy("date").agg(F.count("*").alias("both"))
    return order.filter("prev is not null").join(both, "date", "left").select("date", ((F.col("n") + F.col("was") - 2 * F.coalesce("both", F.lit(0))) / F.col("was")).alias("turnover"))


def cross_sectional(d: DataFrame, x: str = "x", y: str = "fwd_1") -> DataFrame:
    """One row: mean and deviation of IC and rank IC, their ratios, hit rate, pooled quintile spread, top-fifth turnover."""
    d = d.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select("date", "ticker", F.col(x).alias("x"), F.col(y).alias("y"))
    ics = [E.ic_series(d, "x", "y", ranked).filter("ic is not null").select("date", F.col("ic").alias(n)) for ranked, n in ((False, "ic"), (True, "rank_ic"))]
    ratio = lambda n: F.coalesce(W.div(F.avg(n), F.nullif(F.stddev_samp(n), F.lit(0.0))), F.lit(0.0))
    one = ics[0].join(ics[1], "date", "full").agg(
        F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.avg("rank_ic").alias("mean_rank_ic"), F.stddev_samp("rank_ic").alias("std_rank_ic"),
        ratio("ic").alias("ic_ir"), ratio("rank_ic").alias("rank_ic_ir"), F.avg((F.col("ic") > E.TINY).cast("double")).alias("hit_rate"), F.count("ic").alias("n_periods"),
    )
    bins = d.withColumn("bin", E.quantile_bin(F.col("x"), 5, "date")).groupBy("bin").agg(F.avg("y").alias("r"))
    spread = bins.agg((F.max_by("r", "bin") - F.min_by("r", "bin")).alias("monotonicity"))
    turn = top_change(d).agg(F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("turnover"))
    return one.crossJoin(spread).crossJoin(turn)  # one row each


def time_series(d: DataFrame, x: str = "x", y: str = "fwd_1") -> DataFrame:
    """One row: hit rate, directional Sharpe of the daily mean of x * y, mean absolute error, mean hit rate of a ticker."""
    d = d.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select("date", "ticker", F.col(x).alias("x"), F.col(y).alias("y"))
    d = d.withColumn("hit", ((F.signum("x") == F.signum("y")) & (F.col("x") != 0)).cast("double"))
    one = d.agg(F.avg("hit").alias("hit_rate"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_absolute_error"), F.count("*").alias("n"), F.countDistinct("ticker").alias("n_tickers"))
    daily = d.groupBy("date").agg(F.avg(F.col("x") * F.col("y")).alias("r")).agg(F.coalesce(sharpe("r"), F.lit(0.0)).alias("directional_sharpe"))
    own = d.groupBy("ticker").agg(F.avg("hit").alias("h")).agg(F.avg("h").alias("ticker_hit_rate"))
    return one.crossJoin(daily).crossJoin(own)  # one row each


def drawdown(d: DataFrame, x: str) -> DataFrame:
    """date, x and the fall of its compounded value below its highest so far; one row a date."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    value = F.exp(F.sum(F.log1p(F.greatest(F.col(x), F.lit(-0.999999)))).over(w))
    return d.withColumn("_v", value).withColumn("drawdown", F.col("_v") / F.max("_v").over(w) - 1).drop("_v")


def regime(market: DataFrame, prob: DataFrame, limit: float = 0.5) -> DataFrame:
    """One row: Sharpe and largest drawdown of the market (date, mkt) as it is, and with exposure 1 - p on dates with p > limit.

    prob: date, prob (several rows a date are averaged).
    """
    p = prob.groupBy("date").agg(F.avg("prob").alias("p"))
    d = market.join(p, "date").filter("mkt is not null and p is not null")
    high = F.col("p") > limit
    d = d.withColumns({"share": F.when(high, 1 - F.col("p")).otherwise(1.0), "high": high.cast("double")}).withColumn("over", F.col("mkt") * F.col("share"))
    d = drawdown(drawdown(d, "mkt").withColumnRenamed("drawdown", "dd_base"), "over").withColumnRenamed("drawdown", "dd_over")
    return d.agg(
        F.coalesce(sharpe("mkt"), F.lit(0.0)).alias("baseline_sharpe"), F.coalesce(sharpe("over"), F.lit(0.0)).alias("overlay_sharpe"),
        F.abs(F.min("dd_base")).alias("baseline_max_dd"), F.abs(F.min("dd_over")).alias("overlay_max_dd"),
        F.avg("high").alias("detection_rate"), F.avg(1 - F.col("share")).alias("exposure_reduction"), F.count("*").alias("n_periods"),
    )


def half_life(d: DataFrame, x: str, least: int = 30) -> DataFrame:
    """ticker, n, rho (first-order autocorrelation), r2 and half_life in rows (null where rho is not between 0 and 1)."""
    pairs = d.withColumn("_l", W.lag(F.col(x))).filter(F.col(x).isNotNull() & F.col("_l").isNotNull())
    rho = W.corr(F.col(x), F.col("_l"))
    out = pairs.groupBy("ticker").agg(F.count("*").alias("n"), rho.alias("rho")).filter(F.col("n") >= least - 1)
    return out.withColumns({"r2": F.col("rho") * F.col("rho"), "half_life": F.when((F.col("rho") > 0) & (F.col("rho") < 1), -math.log(2) / F.log("rho"))})


def per_stock(d: DataFrame, x: str = "x", y: str = "fwd_1", least: int = 30) -> DataFrame:
    """ticker, n and the correlation of x and y over its rows, for tickers with ``least`` pairs."""
    both = d.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy("ticker").agg(F.count("*").alias("n"), W.corr(F.col(x), F.col(y)).alias("corr")).filter(F.col("n") >= least)


def signal_summary(d: DataFrame, x: str = "x", y: str = "fwd_1") -> DataFrame:
    return per_stock(d, x, y).agg(F.avg("corr").alias("mean_ts_corr"), F.percentile("corr", F.lit(0.5)).alias("median_ts_corr"), F.avg((F.col("corr") > E.TINY).cast("double")).alias("share_positive"), F.count("*").alias("n_stocks"))


def hit_rates(d: DataFrame, x: str, ret: str, limit: float, lag: int = 1) -> DataFrame:
    """One row a ticker: share of rows whose lagged signal has the sign of the return (10 rows at least), and hit rates of strong signals (over 5)."""
    s = W.lag(F.col(x), lag)
    d = d.withColumn("_s", s).filter(F.col("_s").isNotNull() & F.col(ret).isNotNull())
    up, down = F.col("_s") > limit, F.col("_s") < -limit
    rate = lambda when, hit: F.when(F.count(F.when(when, 1)) > 5, F.avg(F.when(when, hit.cast("double"))))
    return d.groupBy("ticker").agg(
        F.when(F.count("*") >= 10, F.avg((F.signum("_s") == F.signum(ret)).cast("double"))).alias("accuracy"),
        rate(up, F.col(ret) > 0).alias("long_hit"), rate(down, F.col(ret) < 0).alias("short_hit"),
        F.count(F.when(up, 1)).alias("n_long"), F.count(F.when(down, 1)).alias("n_short"),
    )


def horizons(long: DataFrame, hs: tuple[int, ...], q: int = 5) -> DataFrame:
    """factor, h: mean IC and rank IC with t, annualised Sharpe of the long-short return, monotonicity; long has value and fwd_<h>."""
    d = long.unpivot(["date", "ticker", "factor", "value"], [f"fwd_{h}" for h in hs], "h", "fwd").withColumn("h", F.substring("h", 5, 9).cast("int"))
    d = d.filter("value is not null and fwd is not null")
    by = ("factor", "h", "date")
    ics = [E.ic_series(d, "value", "fwd", ranked, by=by).select(*by, F.col("ic").alias(n)) for ranked, n in ((False, "ic"), (True, "ric"))]
    t = lambda n: W.div(F.avg(n), F.nullif(F.stddev_samp(n), F.lit(0.0))) * F.sqrt(F.count(n))
    ic = ics[0].join(ics[1], list(by)).groupBy("factor", "h").agg(F.avg("ic").alias("ic_mean"), t("ic").alias("ic_t"), F.avg("ric").alias("ric_mean"), t("ric").alias("ric_t"))
    bins = d.withColumn("bin", E.quantile_bin(F.col("value"), q, *by)).groupBy(*by, "bin").agg(F.avg("fwd").alias("ret"))
    ls = bins.groupBy(*by).agg((F.max(F.when(F.col("bin") == q, F.col("ret"))) - F.max(F.when(F.col("bin") == 1, F.col("ret")))).alias("ls"))
    ls = ls.groupBy("factor", "h").agg(F.avg("ls").alias("ls_mean"), F.stddev_samp("ls").alias("ls_sd"))
    means = bins.groupBy("factor", "h", "bin").agg(F.avg("ret").alias("ret"))
    mono = E.ic_series(means, "bin", "ret", least=3, by=("factor", "h")).select("factor", "h", F.col("ic").alias("monotonicity"))
    out = ic.join(ls, ["factor", "h"]).join(mono, ["factor", "h"], "left")
    return out.withColumn("ls_sharpe", W.div(F.col("ls_mean"), F.nullif(F.col("ls_sd"), F.lit(0.0))) * F.sqrt(252.0 / F.col("h")))


def tear_sheet(long: DataFrame, hs: tuple[int, ...] = (1, 5, 10, 20), cost_bps: float = 10.0) -> DataFrame:
    """One row a factor: the shortest horizon's statistics after costs, break-even cost, and how many horizons agree in sign."""
    h = horizons(long, hs)
    sign = h.groupBy("factor").agg(F.greatest(F.count(F.when(F.col("ric_mean") > 0, 1)), F.count(F.when(F.col("ric_mean") < 0, 1))).alias("_a"), F.count(F.when(F.col("ric_mean") != 0, 1)).alias("_n"))
    turn = turnover(long).groupBy("factor").agg(F.avg("turnover").alias("mean_turnover"))
    d = h.filter(F.col("h") == min(hs)).join(turn, "factor", "left").join(sign, "factor")
    net = F.col("ls_mean") - F.coalesce("mean_turnover", F.lit(0.0)) * cost_bps / 10_000
    return d.select(
        "factor", "ic_mean", "ric_mean", "ric_t", "ls_sharpe", "monotonicity", "mean_turnover", net.alias("net_ls_mean"), (W.div(net, F.nullif(F.col("ls_sd"), F.lit(0.0))) * YEAR).alias("net_ls_sharpe"),
        (F.col("ls_mean") / F.greatest(F.col("mean_turnover"), F.lit(1e-12)) * 10_000).alias("break_even_bps"), W.div(F.col("_a"), F.nullif(F.col("_n"), F.lit(0))).alias("sign_consistency"),
    )


def turnover(long: DataFrame, least: int = 5) -> DataFrame:
    """factor, date, turnover: 1 - rank correlation with the factor's values on the date before, over the names in both."""
    d = long.filter("value is not null").select("factor", "date", "ticker", "value")
    order = d.select("factor", "date").distinct().withColumn("prev", F.lag("date").over(Window.partitionBy("factor").orderBy("date")))
    both = d.join(order.filter("prev is not null"), ["factor", "date"]).join(d.select("factor", F.col("date").alias("prev"), "ticker", F.col("value").alias("u")), ["factor", "prev", "ticker"])
    return E.ic_series(both, "value", "u", least=least, by=("factor", "date")).select("factor", "date", (1 - F.col("ic")).alias("turnover"))


def oos_stability(ic: DataFrame, fold_table: DataFrame) -> DataFrame:
    """One row: mean, deviation and share of positive mean ICs over the test spans of the folds."""
    from .analytics import fold_ic

    t = fold_ic(ic, fold_table).filter("part = 'test'")
    return t.agg(F.avg("mean_ic").alias("oos_mean"), F.stddev_samp("mean_ic").alias("oos_sd"), F.avg((F.col("mean_ic") > E.TINY).cast("double")).alias("oos_positive"), F.count("*").alias("folds"))


def select_per_fold(ic: DataFrame, fold_table: DataFrame, k: int) -> DataFrame:
    """fold, factor, mean_ic, rank: the k factors with the best mean IC in each fold's training span; ic: date, factor, ic."""
    d = ic.join(F.broadcast(fold_table), (ic["date"] >= fold_table["train_start"]) & (ic["date"] < fold_table["train_end"]))  # a few rows
    m = d.groupBy("fold", "factor").agg(F.avg("ic").alias("mean_ic"))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("fold").orderBy(F.col("mean_ic").desc_nulls_last(), "factor"))).filter(F.col("rank") <= k)


def fold_portfolios(long: DataFrame, fold_table: DataFrame, chosen: DataFrame, fwd: str = "fwd_1", least: int = 10) -> DataFrame:
    """fold, n, ann_return, sharpe, max_drawdown of holding the top fifth of the chosen factors' mean value in the test span."""
    f = fold_table.select("fold", "train_end", "test_end")
    d = long.join(F.broadcast(f), (long["date"] >= f["train_end"]) & (long["date"] < f["test_end"])).join(F.broadcast(chosen.select("fold", "factor")), ["fold", "factor"])  # k rows a fold
    d = d.filter(F.col("value").isNotNull()).groupBy("fold", "date", "ticker").agg(F.avg("value").alias("v"), F.first(fwd).alias("r")).filter("r is not null")
    day = Window.partitionBy("fold", "date")
    d = d.withColumns({"_c": F.percentile("v", F.lit(0.8)).over(day), "_n": F.count("*").over(day)}).filter((F.col("v") >= F.col("_c")) & (F.col("_n") >= least))
    daily = d.groupBy("fold", "date").agg(F.avg("r").alias("r"))
    w = Window.partitionBy("fold").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    daily = daily.withColumn("_v", F.exp(F.sum(F.log1p("r")).over(w))).withColumn("_d", F.col("_v") / F.greatest(F.max("_v").over(w), F.lit(1.0)) - 1)
    n = F.count("*")
    return daily.groupBy("fold").agg(n.alias("n"), (F.exp(F.sum(F.log1p("r")) * 252.0 / n) - 1).alias("ann_return"), sharpe("r").alias("sharpe"), F.min("_d").alias("max_drawdown"))


def deflated_long_short(d: DataFrame, x: str = "ls_sharpe") -> DataFrame:
    """d with the Sharpe ratio less what the best of so many tries reaches by luck."""
    n = F.count("*").over(Window.partitionBy())  # one row a factor
    return d.withColumn("deflated", F.col(x) - F.sqrt(2 * F.log(n.cast("double"))) / YEAR)


def long_short_panel(long: DataFrame, fwd: str = "fwd_1", q: int = 5) -> DataFrame:
    """factor, date, ls: each factor's return of its top less its bottom quantile."""
    d = long.filter(F.col("value").isNotNull() & F.col(fwd).isNotNull())
    d = d.withColumn("bin", E.quantile_bin(F.col("value"), q, "factor", "date")).groupBy("factor", "date", "bin").agg(F.avg(fwd).alias("ret"))
    return d.groupBy("factor", "date").agg((F.max(F.when(F.col("bin") == q, F.col("ret"))) - F.max(F.when(F.col("bin") == 1, F.col("ret")))).alias("ls"))


def panel_correlation(ls: DataFrame) -> DataFrame:
    """f1, f2, corr over the dates both factors have."""
    a, b = ls.select("date", F.col("factor").alias("f1"), F.col("ls").alias("a")), ls.select("date", F.col("factor").alias("f2"), F.col("ls").alias("b"))
    return a.join(b, "date").filter("f1 < f2").groupBy("f1", "f2").agg(W.corr(F.col("a"), F.col("b")).alias("corr"))


def date_correlation(long: DataFrame, least: int = 10) -> DataFrame:
    """f1, f2 and the mean over dates of the factors' rank correlation, on dates with ``least`` names."""
    d = long.filter("value is not null").select("date", "ticker", "factor", "value")
    pair = d.select("date", "ticker", F.col("factor").alias("f1"), F.col("value").alias("a")).join(d.select("date", "ticker", F.col("factor").alias("f2"), F.col("value").alias("b")), ["date", "ticker"]).filter("f1 < f2")
    ic = E.ic_series(pair, "a", "b", least=least, by=("f1", "f2", "date"))
    return ic.groupBy("f1", "f2").agg(F.avg("ic").alias("corr"), F.count("ic").alias("n"))


def rolling_z(x: Column, n: int, least: int = 5) -> Column:
    """(x - mean) / population deviation of the last n rows, once there are n rows and ``least`` values; 0 for constant ones."""
    w = W.last_rows(n)
    sd = F.stddev_pop(x).over(w)
    full = (F.count(F.lit(1)).over(w) >= n) & (F.count(x).over(w) >= least) & x.isNotNull()
    return F.when(full, F.coalesce(W.div(x - F.avg(x).over(w), F.when(sd > 1e-12, sd)), F.lit(0.0)))


def momentum_signal(z: Column, limit: float = 2.0) -> Column:
    """-1 above the limit, +1 below its negative, else 0."""
    return F.when(z > limit, -1.0).when(z < -limit, 1.0).otherwise(0.0)


def ensemble(cs: DataFrame, ts: DataFrame, share: float = 0.6) -> DataFrame:
    """date, ticker, alpha: share of the cross-sectional score and the rest of the time-series one; a missing one counts 0."""
    d = cs.select("date", "ticker", F.col("score").alias("_c")).join(ts.select("date", "ticker", F.col("score").alias("_t")), ["date", "ticker"], "full")
    return d.select("date", "ticker", (share * F.coalesce("_c", F.lit(0.0)) + (1 - share) * F.coalesce("_t", F.lit(0.0))).alias("alpha"))


def spread(d: DataFrame, x: str, ret: str, share: float = 0.2, least: int = 10) -> DataFrame:
    """date, spread: mean return of the top less the bottom ``share`` of names by the signal of the row before, on dates with ``least`` names."""
    d = d.withColumn("_s", W.lag(F.col(x))).filter(F.col("_s").isNotNull() & F.col(ret).isNotNull())
    cut = lambda p: F.percentile("_s", F.lit(p)).over(W.by_date())
    d = d.withColumns({"_hi": cut(1 - share), "_lo": cut(share)})
    top, low = F.avg(F.when(F.col("_s") >= F.col("_hi"), F.col(ret))), F.avg(F.when(F.col("_s") <= F.col("_lo"), F.col(ret)))
    return d.groupBy("date").agg(F.count("*").alias("n"), (top - low).alias("spread")).filter(F.col("n") >= least)


def decompose_return(d: DataFrame, x: str = "ret", m: str = "mkt", rf: float = 0.0) -> DataFrame:
    """One row: annualised return, the benchmark's, and what beta, alpha and the rest contribute."""
    day = (1 + rf) ** (1 / 252) - 1
    n = F.count("*")
    year = lambda c: F.exp(F.sum(F.log1p(c)) * 252.0 / n) - 1
    both = d.filter(F.col(x).isNotNull() & F.col(m).isNotNull()).select(F.col(x).alias("_x"), F.col(m).alias("_m"))
    beta = W.div(F.covar_samp("_x", "_m"), F.var_samp("_m"))
    one = both.agg(year("_x").alias("total_return"), year("_m").alias("benchmark_return"), beta.alias("beta"), ((F.avg("_x") - day - beta * (F.avg("_m") - day)) * 252).alias("alpha_contribution"))
    one = one.withColumn("beta_contribution", F.col("beta") * (F.col("benchmark_return") - rf))
    return one.withColumns({"residual_contribution": F.col("total_return") - rf - F.col("beta_contribution") - F.col("alpha_contribution"), "active_return": F.col("total_return") - F.col("benchmark_return")})


def cost_ablation(weights: DataFrame, prices: DataFrame, models: dict) -> DataFrame:
    """model, trades, cost: what the same trades cost under each cost model."""
    from .costs import generate_trades

    out = None
    for name, model in models.items():
        t = generate_trades(weights, prices, model=model).filter("shares > 0").agg(F.lit(name).alias("model"), F.count("*").alias("trades"), F.sum("total_cost").alias("cost"))
        out = t if out is None else out.unionByName(t)
    return out


def var_backtest(d: DataFrame, x: str = "ret", confidence: float = 0.95) -> DataFrame:
    """n, breaches, rate, Kupiec's likelihood ratio and its p-value; d: date, x and var, which is compared with the next date's x."""
    d = d.withColumn("_v", F.lag("var").over(Window.orderBy("date"))).filter(F.col("_v").isNotNull() & F.col(x).isNotNull())  # one row a date
    one = d.agg(F.count("*").alias("n"), F.count(F.when(F.col(x) < -F.col("_v"), 1)).alias("breaches"))
    n, k, p = F.col("n"), F.col("breaches"), 1 - confidence
    rate = W.div(k, n)
    log = lambda a: F.log(F.greatest(a, F.lit(1e-300)))
    lr = F.greatest(F.lit(0.0), -2 * ((n - k) * math.log(1 - p) + k * math.log(p) - (n - k) * log(1 - rate) - k * log(rate)))
    return one.withColumns({"rate": rate, "lr": lr})


def orthogonal(candidate: DataFrame, baseline: DataFrame, least: int = 10) -> DataFrame:
    """date, ticker, value: what a date's line through (baseline, candidate) leaves of the candidate; dates with ``least`` names."""
    j = candidate.select("date", "ticker", F.col("value").alias("_v")).join(baseline.select("date", "ticker", F.col("value").alias("_b")), ["date", "ticker"]).filter("_v is not null and _b is not null")
    line = j.groupBy("date").agg(F.regr_slope("_v", "_b").alias("_s"), F.regr_intercept("_v", "_b").alias("_i"), F.count("*").alias("_n")).filter((F.col("_n") >= least) & F.col("_s").isNotNull())
    return j.join(line, "date").select("date", "ticker", (F.col("_v") - F.col("_i") - F.col("_s") * F.col("_b")).alias("value"))


def regime_policy(long: DataFrame, controls: DataFrame) -> DataFrame:
    """long without the factors that a date's controls (date, disabled, multiplier) turn off, the others times the multiplier."""
    d = long.join(controls, "date", "left").filter(~F.coalesce(F.array_contains("disabled", F.col("factor")), F.lit(False)))
    return d.withColumn("value", F.col("value") * F.coalesce("multiplier", F.lit(1.0))).drop("disabled", "multiplier")


def features(d: DataFrame, n: int = 20, least: int = 10) -> DataFrame:
    """The inputs that many factors share, worked out in one pass over the ticker windows; date means are joined back."""
    two = W.last_rows(2)
    d = d.withColumns({
        "abs_ret": F.abs("ret"), "ret_5": W.pct_change(F.col("close"), 5), "dollar_volume": F.col("close") * F.col("volume"),
        f"vol_{n}": W.roll(F.stddev_samp, F.col("ret"), n, least), f"volume_mean_{n}": W.roll(F.avg, F.col("volume"), n, least),
        f"volume_sd_{n}": W.roll(F.stddev_samp, F.col("volume"), n, least), "high_2": F.max("high").over(two), "low_2": F.min("low").over(two),
    })
    return d.join(d.groupBy("date").agg(F.avg("ret").alias("market_ret")), "date", "left")
