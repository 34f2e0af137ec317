"""Queries of portfolios, costs, backtests, risk and streams, with their oracles."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import alpha as A
from ..operators import analytics as N
from ..operators import costs as C
from ..operators import evaluation as E
from ..operators import factors, risk_model
from ..operators import portfolio as PF
from ..sources import panel
from ..streaming import live
from . import sql
from .panel_queries import _EFF, P, RIC, SIG, W_T, _r, effective, evaluated, rank_ic, signal

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


# --- portfolios -------------------------------------------------------------------------------------------------------

REB = SIG + """, rb AS (SELECT max(date) AS date FROM p GROUP BY date_trunc('month', date)), g AS (SELECT x.date, ticker, x FROM x JOIN rb ON x.date = rb.date WHERE x IS NOT NULL),
rn AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY x, ticker) AS k, count(*) OVER (PARTITION BY date) AS n FROM g),
qs AS (SELECT date, ticker, x, greatest(1, CAST(ceil((k - 1) * 5.0 / nullif(n - 1, 0)) AS INTEGER)) AS bin FROM rn), sd AS (SELECT date, ticker, x, bin, CASE WHEN bin = 5 THEN 1 ELSE -1 END AS side FROM qs WHERE bin IN (1, 5)),
we AS (SELECT date, ticker, side * 1.0 / count(*) OVER (PARTITION BY date, side) AS weight FROM sd), wl AS (SELECT date, ticker, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM sd WHERE side = 1)"""


def monthly(s: SparkSession, d: str) -> DataFrame:
    sig = signal(s, d)
    return sig.join(F.broadcast(PF.rebalance_dates(sig)), "date", "left_semi")


def weights(s: SparkSession, d: str, short: bool = True) -> DataFrame:
    return PF.weigh(PF.quantile_sides(monthly(s, d), "x", short=short)).select("date", "ticker", "weight")


@query("pf1_rebalance_dates", f"{P} SELECT max(date) AS date FROM p GROUP BY date_trunc('week', date)")
def _(s, d):
    return PF.rebalance_dates(panel.bars(s, d), "W")


@query("pf2_quantile_sides", REB + " SELECT date, ticker, bin, side FROM sd")
def _(s, d):
    return PF.quantile_sides(monthly(s, d), "x").select("date", "ticker", "bin", "side")


@query("pf3_top_n", SIG + " SELECT date, ticker FROM (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY x DESC, ticker) AS k FROM x WHERE x IS NOT NULL) WHERE k <= 3")
def _(s, d):
    return PF.top_n(signal(s, d), "x", 3).select("date", "ticker")


@query("pf4_equal_weights", REB + " SELECT date, ticker, round(weight, 8) AS weight FROM we")
def _(s, d):
    return weights(s, d).select("date", "ticker", *_r("weight", digits=8))


@query("pf6_signal_weights", REB + " SELECT date, ticker, round(coalesce(abs(x) / nullif(sum(abs(x)) OVER (PARTITION BY date, side), 0), 0) * side, 6) AS weight FROM sd")
def _(s, d):
    return PF.weigh(PF.quantile_sides(monthly(s, d), "x"), F.abs("x")).select("date", "ticker", *_r("weight"))


@query("pf7_inverse_volatility", REB + f", vo AS (SELECT date, ticker, {sql.roll('stddev_samp(?)', 'ret', 63, 20)} AS v FROM p) SELECT sd.date, sd.ticker, round(coalesce((1 / v) / sum(1 / v) OVER (PARTITION BY sd.date, side), 0) * side, 6) AS weight FROM sd JOIN vo ON sd.date = vo.date AND sd.ticker = vo.ticker")
def _(s, d):
    v = PF.inverse_volatility(panel.returns(s, d)).select("date", "ticker", "vol")
    return PF.weigh(PF.quantile_sides(monthly(s, d), "x").join(v, ["date", "ticker"]), W.div(F.lit(1.0), F.col("vol"))).select("date", "ticker", *_r("weight"))


@query("pf12_constraints", REB + f""", {sql.SECTORS}, c AS (SELECT wl.date, wl.ticker, sector, least(weight, 0.2) AS w FROM wl JOIN s ON wl.ticker = s.ticker), t AS (SELECT *, sum(w) OVER (PARTITION BY date, sector) AS g FROM c),
k AS (SELECT date, ticker, CASE WHEN g > 0.3 THEN w * 0.3 / g ELSE w END AS w FROM t) SELECT date, ticker, round(w / sum(w) OVER (PARTITION BY date), 6) AS weight FROM k WHERE w > 1e-10""")
def _(s, d):
    w = weights(s, d, short=False).join(F.broadcast(panel.sectors(s, d)), "ticker", "left")
    return PF.constrain(w, high=0.2, sector_cap=0.3).select("date", "ticker", *_r("weight"))


@query("pf14_carry_forward", REB + ", dd AS (SELECT DISTINCT date FROM p), m AS (SELECT dd.date, max(r.date) AS reb FROM dd JOIN (SELECT DISTINCT date FROM wl) r ON r.date <= dd.date GROUP BY dd.date) SELECT m.date, ticker, round(weight, 8) AS weight FROM m JOIN wl ON wl.date = m.reb")
def _(s, d):
    return PF.carry_forward(weights(s, d, short=False), panel.bars(s, d)).select("date", "ticker", *_r("weight", digits=8))


_CH = REB + """, o AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM wl)), ol AS (SELECT o.nxt AS date, ticker, weight FROM wl JOIN o ON wl.date = o.date WHERE o.nxt IS NOT NULL),
ch AS (SELECT coalesce(wl.date, ol.date) AS date, coalesce(wl.ticker, ol.ticker) AS ticker, coalesce(ol.weight, 0) AS weight_from, coalesce(wl.weight, 0) AS weight_to FROM wl FULL JOIN ol ON wl.date = ol.date AND wl.ticker = ol.ticker)"""


@query("pf16_turnover", _CH + " SELECT date, round(sum(abs(weight_to - weight_from)) / 2, 6) AS turnover FROM ch GROUP BY date")
def _(s, d):
    return PF.turnover(weights(s, d, short=False)).select("date", *_r("turnover"))


@query("pf11_turnover_clip")
def _(s, d):
    return PF.clip_turnover(weights(s, d, short=False), 0.3).select("date", "ticker", *_r("weight"))


# --- costs and backtest -----------------------------------------------------------------------------------------------

_TR = _CH + f""", pv AS (SELECT date, ticker, close, {sql.roll('avg(?)', 'volume', 20, 5)} AS adv, {sql.roll('stddev_samp(?)', 'ret', 20, 5)} AS vol FROM p),
tr AS (SELECT ch.date, ch.ticker, weight_to - weight_from AS delta, close, coalesce(adv, 1e6) AS adv, coalesce(vol, 0.02) AS vol, round_even(abs(weight_to - weight_from) * 1e6 / close, 0) AS shares FROM ch JOIN pv ON ch.date = pv.date AND ch.ticker = pv.ticker WHERE abs(weight_to - weight_from) > 1e-10),
tc AS (SELECT *, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side, shares * close AS notional, CASE WHEN shares > 0 THEN greatest(shares * 0.005, 1) + shares * close * 0.0005 + 0.1 * vol * sqrt(shares / greatest(adv, 1)) * shares * close
 + CASE WHEN delta < 0 THEN shares * close * 8e-6 + shares * 1.19e-4 ELSE 0 END ELSE 0 END AS cost FROM tr)"""


def market_data(s: SparkSession, d: str) -> DataFrame:
    return panel.returns(s, d).select("date", "ticker", "close", "ret", W.roll(F.avg, F.col("volume"), 20, 5).alias("adv"), W.roll(F.stddev_samp, F.col("ret"), 20, 5).alias("vol"))


def trades(s: SparkSession, d: str) -> DataFrame:
    return C.generate_trades(weights(s, d, short=False), market_data(s, d))


@query("ex6_trades", _TR + " SELECT date, ticker, side, shares, round(notional, 4) AS notional, round(round(cost, 4), 1) AS cost FROM tc")
def _(s, d):
    return trades(s, d).select("date", "ticker", "side", "shares", F.round("notional", 4).alias("notional"), F.round("total_cost", 1).alias("cost"))


@query("ex4_cost_attribution", _TR + " SELECT 'slippage' AS kind, round(sum(round(notional * 0.0005, 4)), 2) AS cost, round(sum(notional * 0.0005) / sum(notional) * 1e4, 4) AS bps FROM tc")
def _(s, d):
    return C.attribution(trades(s, d)).filter("kind = 'slippage'").select("kind", F.round("cost", 2).alias("cost"), F.round("bps", 4).alias("bps"))


_PNL = REB + """, dd AS (SELECT DISTINCT date FROM p), m AS (SELECT dd.date, max(r.date) AS reb FROM dd JOIN (SELECT DISTINCT date FROM wl) r ON r.date <= dd.date GROUP BY dd.date),
dw AS (SELECT m.date, ticker, weight * 0.05 AS weight FROM m JOIN wl ON wl.date = m.reb), gr AS (SELECT dw.date, sum(weight * coalesce(ret, 0)) AS g FROM dw LEFT JOIN p ON p.date = dw.date AND p.ticker = dw.ticker GROUP BY dw.date),
pp AS (SELECT date, g, CASE WHEN row_number() OVER (ORDER BY date) % 21 = 1 THEN 100.0 ELSE 0.0 END AS cost, product(1 + g) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS pr FROM gr),
nv AS (SELECT *, 1e6 * pr AS nav_gross, pr * (1e6 - sum(cost / pr) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS nav_net FROM pp),
nr AS (SELECT *, nav_net / coalesce(lag(nav_net) OVER (ORDER BY date), 1e6) - 1 AS net_ret, nav_net / greatest(max(nav_net) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 1e6) - 1 AS dd FROM nv)"""


def pnl(s: SparkSession, d: str) -> DataFrame:
    w = PF.carry_forward(weights(s, d, short=False).withColumn("weight", F.col("weight") * 0.05), panel.bars(s, d))
    days = w.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")))
    return C.daily_pnl(w, panel.returns(s, d), days.select("date", F.when(F.col("k") % 21 == 1, 100.0).otherwise(0.0).alias("cost")))


@query("ex8_daily_pnl", _PNL + " SELECT date, round(g, 8) AS gross_ret, round(net_ret, 8) AS net_ret, round(ln(nav_net), 7) AS log_nav, round(dd, 6) AS drawdown FROM nr")
def _(s, d):
    return pnl(s, d).select("date", *_r("gross_ret", "net_ret", digits=8), F.round(F.log("nav_net"), 7).alias("log_nav"), F.round("drawdown_net", 6).alias("drawdown"))


@query("ex9_performance", _PNL + " SELECT round(product(1 + net_ret) ^ (252.0 / count(*)) - 1, 6) AS ann_return, round(stddev_samp(net_ret) * sqrt(252), 6) AS ann_vol, round(min(dd), 6) AS max_drawdown, round(avg(CASE WHEN net_ret > 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, count(*) AS n FROM nr")
def _(s, d):
    return C.performance(pnl(s, d)).select(*_r("ann_return", "ann_vol", "max_drawdown", "hit_rate"), "n")


@query("ex7_simulate_execution")
def _(s, d):
    return C.simulate_execution(weights(s, d, short=False), market_data(s, d))


@query("ex5_china_costs", _CH + " SELECT date, round(sum(abs(weight_to - weight_from) * (0.0003 + 0.00001 + 0.0005) + CASE WHEN weight_to < weight_from THEN (weight_from - weight_to) * 0.0005 ELSE 0 END), 8) AS cost FROM ch GROUP BY date")
def _(s, d):
    ch = PF.changes(weights(s, d, short=False)).withColumn("delta", F.col("weight_to") - F.col("weight_from"))
    return ch.groupBy("date").agg(F.round(F.sum(C.ChinaCostModel().rate(F.col("delta"), 1e6, F.lit(1e6), F.lit(0.02))), 8).alias("cost"))


@query("ex12_capacity_curve")
def _(s, d):
    return C.capacity_curve(trades(s, d), pnl(s, d)).select("scale", *_r("net_sharpe", "cost", "participation_p95", digits=4))


# --- analytics --------------------------------------------------------------------------------------------------------

_MK = f"{P}, m AS (SELECT date, avg(ret) AS mkt FROM p GROUP BY date), r AS (SELECT date, avg(ret) AS ret FROM p WHERE ticker IN ('S1', 'S2', 'S3', 'S4', 'S5', 'S6', 'S7', 'S8') GROUP BY date), j AS (SELECT r.date, r.ret, mkt FROM r JOIN m ON r.date = m.date WHERE r.ret IS NOT NULL AND mkt IS NOT NULL)"


def book(s: SparkSession, d: str) -> DataFrame:
    p = panel.returns(s, d)
    r = p.filter(F.col("ticker").isin(*[f"S{i}" for i in range(1, 9)])).groupBy("date").agg(F.avg("ret").alias("ret"))
    return r.join(panel.market(p), "date").dropna()


@query("pe1_risk_summary", _MK + ", q AS (SELECT quantile_cont(ret, 0.05) AS q FROM j) SELECT count(*) AS n, round(greatest(0, -min(q)), 6) AS var_hist, round(greatest(0, -avg(CASE WHEN ret <= least(q, 0) THEN ret END)), 6) AS cvar_hist, round(greatest(0, -(avg(ret) - 1.6448536269514722 * stddev_samp(ret))), 6) AS var_normal FROM j, q")
def _(s, d):
    return N.risk_summary(book(s, d).select("date", "ret")).select("n", *_r("var_hist", "cvar_hist", "var_normal"))


@query("pe5_rolling_var", _MK + " SELECT date, round(CASE WHEN count(ret) OVER v >= 126 THEN greatest(0, -quantile_cont(ret, 0.05) OVER v) END, 6) AS var FROM j WINDOW v AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)")
def _(s, d):
    return N.rolling_var(book(s, d)).select("date", *_r("var"))


@query("pe8_capm", _MK + " SELECT count(*) AS n, round(regr_slope(ret, mkt), 6) AS beta, round(regr_intercept(ret, mkt), 6) AS alpha, round(regr_r2(ret, mkt), 6) AS r2, round(stddev_samp(ret - mkt) * sqrt(252), 5) AS tracking_error, round(avg(ret) * 252 / regr_slope(ret, mkt), 5) AS treynor FROM j")
def _(s, d):
    return N.benchmark_stats(book(s, d)).select("n", *_r("beta", "alpha", "r2"), *_r("tracking_error", "treynor", digits=5))


@query("pe10_rolling_beta", _MK + " SELECT date, round(CASE WHEN count(*) OVER v = 252 THEN regr_slope(ret, mkt) OVER v END, 6) AS beta, round(CASE WHEN count(*) OVER v = 252 THEN regr_r2(ret, mkt) OVER v END, 6) AS r2 FROM j WINDOW v AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)")
def _(s, d):
    return N.rolling_benchmark(book(s, d)).select("date", *_r("beta", "r2"))


@query("pe13_sector_exposure", REB + f", {sql.SECTORS} SELECT date, sector, round(sum(greatest(weight, 0)), 8) AS long, round(sum(least(weight, 0)), 8) AS short, round(sum(weight), 8) AS net, count(*) AS n FROM we JOIN s ON we.ticker = s.ticker GROUP BY 1, 2")
def _(s, d):
    w = weights(s, d).join(F.broadcast(panel.sectors(s, d)), "ticker", "left")
    return N.sector_exposure(w).select("date", "sector", *_r("long", "short", "net", digits=8), "n")


@query("pe15_rolling_sharpe", _MK + " SELECT date, round(CASE WHEN count(ret) OVER v >= 126 THEN avg(ret) OVER v / nullif(stddev_samp(ret) OVER v, 0) * sqrt(252) END, 5) AS sharpe FROM j WINDOW v AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)")
def _(s, d):
    return N.rolling_sharpe(book(s, d)).select("date", *_r("sharpe", digits=5))


@query("pe16_crowding", REB + " SELECT we.date, round(sum(weight * x), 5) AS exposure FROM we JOIN x ON we.date = x.date AND we.ticker = x.ticker WHERE x IS NOT NULL GROUP BY we.date")
def _(s, d):
    sig = signal(s, d).filter("x is not null")
    return N.crowding(weights(s, d), sig, ["x"]).select("date", *_r("exposure", digits=5))


@query("pe17_monthly_returns", _MK + " SELECT CAST(date_trunc('month', date) AS DATE) AS period, round(ln(abs(product(1 + ret)) + 1), 6) AS log_ret, count(*) AS n FROM j GROUP BY 1")
def _(s, d):
    r = N.periodic_returns(book(s, d))
    return r.select("period", F.round(F.log(F.abs(F.col("ret") + 1) + 1), 6).alias("log_ret"), "n")


@query("wf1_folds", f"{P}, r AS (SELECT date_trunc('month', min(date)) AS lo, max(date) AS hi FROM p), k AS (SELECT lo, unnest(range(0, 10)) AS fold, hi FROM r) SELECT CAST(fold AS INTEGER) AS fold, CAST(lo + to_months(CAST(fold * 12 AS INTEGER)) AS DATE) AS train_start, CAST(lo + to_months(CAST(fold * 12 + 36 AS INTEGER)) AS DATE) AS train_end, CAST(lo + to_months(CAST(fold * 12 + 48 AS INTEGER)) AS DATE) AS test_end FROM k WHERE lo + to_months(CAST(fold * 12 + 36 AS INTEGER)) <= hi")
def _(s, d):
    return N.folds(panel.bars(s, d))


@query("wf2_fold_ic", RIC + """, r AS (SELECT date_trunc('month', min(date)) AS lo, max(date) AS hi FROM p), kk AS (SELECT lo, unnest(range(0, 10)) AS fold, hi FROM r), fo AS (SELECT fold, lo + to_months(CAST(fold * 12 AS INTEGER)) AS a, lo + to_months(CAST(fold * 12 + 36 AS INTEGER)) AS b, lo + to_months(CAST(fold * 12 + 48 AS INTEGER)) AS c FROM kk WHERE lo + to_months(CAST(fold * 12 + 36 AS INTEGER)) <= hi)
SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN date < b THEN 'train' ELSE 'test' END AS part, round(avg(ic), 6) AS mean_ic, count(ic) AS n FROM ic JOIN fo ON date >= a AND date < c GROUP BY 1, 2""")
def _(s, d):
    return N.fold_ic(rank_ic(s, d), N.folds(panel.bars(s, d))).select("fold", "part", *_r("mean_ic"), "n")


@query("pe19_overfit")
def _(s, d):
    r = panel.returns(s, d).filter("ret is not null").select("date", F.col("ticker").alias("name"), "ret")
    return N.overfit_probability(r)


# --- selection, combination, risk model ------------------------------------------------------------------------------


def long_frame(s: SparkSession, d: str) -> DataFrame:
    fwd = E.forward_returns(panel.returns(s, d), (1,)).select("date", "ticker", F.col("fwd_1").alias("fwd"))
    return effective(s, d).join(fwd, ["date", "ticker"])


_ICIR = _EFF + f""", fw AS (SELECT date, ticker, lead(close, 1) OVER {W_T} / nullif(close, 0) - 1 AS fwd FROM p), lj AS (SELECT e.date, e.ticker, factor, value, fwd FROM e JOIN fw ON e.date = fw.date AND e.ticker = fw.ticker),
lk AS (SELECT date, factor, {sql.rank('value', 'date, factor')} AS a, {sql.rank('fwd', 'date, factor')} AS b FROM lj WHERE fwd IS NOT NULL), li AS (SELECT date, factor, CASE WHEN count(*) >= 5 THEN {sql.corr('a', 'b')} END AS ic FROM lk GROUP BY date, factor),
lr AS (SELECT date, factor, CASE WHEN count(ic) OVER v >= 40 THEN avg(ic) OVER v / nullif(stddev_samp(ic) OVER v, 0) END AS raw FROM li WINDOW v AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)),
lw AS (SELECT date, factor, greatest(lag(raw) OVER (PARTITION BY factor ORDER BY date), 0) AS w FROM lr),
ln AS (SELECT date, factor, CASE WHEN sum(w) OVER d > 0 THEN coalesce(w, 0) / sum(w) OVER d ELSE 1.0 / count(*) OVER d END AS weight FROM lw WINDOW d AS (PARTITION BY date))"""


@query("rd2_factor_correlation", _EFF + f", k AS (SELECT date, ticker, factor, {sql.rank('value', 'date, factor')} / count(*) OVER (PARTITION BY date, factor) AS v FROM e) SELECT a.factor AS f1, b.factor AS f2, round({sql.corr('a.v', 'b.v')}, 6) AS corr, count(*) AS n FROM k a JOIN k b ON a.date = b.date AND a.ticker = b.ticker AND a.factor < b.factor GROUP BY 1, 2")
def _(s, d):
    return A.factor_correlation(effective(s, d)).select("f1", "f2", *_r("corr"), "n")


@query("rd3_cosine", _EFF + " SELECT a.factor AS f1, b.factor AS f2, round(sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)), 6) AS cosine FROM e a JOIN e b ON a.date = b.date AND a.ticker = b.ticker AND a.factor < b.factor GROUP BY 1, 2")
def _(s, d):
    return A.cosine(effective(s, d)).select("f1", "f2", *_r("cosine"))


@query("am6_rolling_icir", _ICIR + " SELECT date, factor, round(weight, 6) AS weight FROM ln")
def _(s, d):
    return A.combine_icir(long_frame(s, d)).select("date", "factor", *_r("weight"))


@query("am11_alpha", _ICIR + " SELECT lj.date, ticker, round(sum(weight * coalesce(value, 0)), 6) AS alpha FROM lj JOIN ln ON lj.date = ln.date AND lj.factor = ln.factor GROUP BY 1, 2")
def _(s, d):
    f = long_frame(s, d)
    return A.alpha_signal(f, A.combine_icir(f)).select("date", "ticker", *_r("alpha"))


@query("am1_weighted_rank", _EFF + " SELECT date, ticker, round(avg(value * CASE WHEN factor = 'STR_1W' THEN 0.4 ELSE 0.6 END), 6) AS score FROM e GROUP BY 1, 2")
def _(s, d):
    return A.weighted_rank(effective(s, d), {"STR_1W": 0.4, "MOM_1M": 0.6}).select("date", "ticker", *_r("score"))


@query("am12_purged_folds", f"{P}, o AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM p)), k AS (SELECT *, n // 6 AS z, unnest(range(1, 6)) AS fold FROM o) SELECT date, CAST(fold AS INTEGER) AS fold, CASE WHEN i < fold * z - 5 THEN 'train' ELSE 'test' END AS part FROM k WHERE i < fold * z - 5 OR (i >= fold * z AND i < CASE WHEN fold = 5 THEN n ELSE fold * z + z END)")
def _(s, d):
    return A.purged_folds(panel.bars(s, d))


@query("am15_walk_forward")
def _(s, d):
    f = factors.compute(panel.returns(s, d), ["STR_1W", "VOL_20D"]).join(E.forward_returns(panel.bars(s, d), (5,)).select("date", "ticker", "fwd_5"), ["date", "ticker"])
    return A.walk_forward(f.dropna(), ["STR_1W", "VOL_20D"], "fwd_5").select("date", "ticker", *_r("prediction"))


@query("se7_tuner")
def _(s, d):
    p = E.forward_returns(panel.returns(s, d), (5,))
    return A.tune(p, lambda k: F.lag(F.col("close"), 1).over(W.by_ticker()) / F.lag(F.col("close"), 1 + k).over(W.by_ticker()) - 1, [5, 21, 63], "fwd_5").select("variant", *_r("mean_ic", "ir"), "n")


@query("rm1_exposures", f"{P}, m AS (SELECT date, avg(ret) AS mkt FROM p GROUP BY date) SELECT ticker, count(*) AS n, round(regr_slope(ret, mkt), 6) AS beta, round(sqrt(greatest(regr_syy(ret, mkt) * (1 - regr_r2(ret, mkt)), 0) / (count(*) - 1) * 252), 5) AS specific FROM p JOIN m ON p.date = m.date WHERE ret IS NOT NULL AND mkt IS NOT NULL GROUP BY ticker HAVING count(*) >= 20")
def _(s, d):
    p = panel.returns(s, d)
    return risk_model.exposures(p.join(panel.market(p), "date")).select("ticker", "n", *_r("beta"), *_r("specific", digits=5))


@query("rm2_ewma_covariance")
def _(s, d):
    return risk_model.ewma_covariance(book(s, d), ["ret", "mkt"]).select("f1", "f2", *_r("cov"))


@query("mv4_mean_variance_weights")
def _(s, d):
    sig = signal(s, d)
    return risk_model.optimise(sig, panel.returns(s, d).filter("ret is not null"), "x", PF.rebalance_dates(sig)).select("date", "ticker", *_r("weight"))


# --- streams ----------------------------------------------------------------------------------------------------------


def _stream(s: SparkSession, d: str, build, name: str, mode: str) -> DataFrame:
    path = s.conf.get("spark.checkpoint.dir", "")
    if not path and not s.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = path.rstrip("/") or tempfile.gettempdir()
    name = f"{name}_{abs(hash((d, name)))}"
    s.catalog.dropTempView(name)
    import uuid

    return live.run_to_end(build(live.quotes(s, f"{d}/events.parquet*")), name, mode, f"{path}/stream-{uuid.uuid4().hex}")


@query("st1_snapshot", "SELECT event_type AS symbol, round(arg_max(value, (ts, event_id)), 6) AS price, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    return _stream(s, d, live.snapshot, "snapshot", "complete").select("symbol", *_r("price"), "n")


@query("st2_bars_batch", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type AS symbol, round(arg_min(value, (ts, event_id)), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, (ts, event_id)), 6) AS close, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    return live.bars(panel.ticks(s, d)).select("start", "symbol", *_r("open", "high", "low", "close"), "n")


@query("st4_rebalance_orders", "WITH px AS (SELECT event_type AS symbol, arg_max(value, (ts, event_id)) AS price FROM events GROUP BY 1), t AS (SELECT symbol, CAST(trunc(0.2 * 1e6 / price) AS BIGINT) AS shares, price FROM px WHERE price > 0) SELECT symbol, shares, round(price, 6) AS price, 'buy' AS side FROM t WHERE shares * price >= 500")
def _(s, d):
    px = live.snapshot(panel.ticks(s, d)).select("symbol", "price")
    targets = px.select("symbol", F.lit(0.2).alias("weight"))
    positions = px.limit(0).select("symbol", F.lit(0).cast("long").alias("position"))
    return live.rebalance_orders(targets, positions, px, 1e6).select("symbol", "shares", *_r("price"), "side")


@query("st5_risk_gate")
def _(s, d):
    o = panel.read(s, d, "events").select(F.col("event_type").alias("account"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_id") % 50 + 1).cast("double").alias("shares"), F.abs("value").alias("price"))
    return live.gate(o)
