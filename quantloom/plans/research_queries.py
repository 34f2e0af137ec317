"""Queries of prepared panels and statements, scorecards, tear sheets and tests of many factors, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import alpha as A
from ..operators import analytics as N
from ..operators import costs as C
from ..operators import evaluation as E
from ..operators import portfolio as PF
from ..operators import risk_model
from ..operators import scorecards as S
from ..sources import data, panel
from ..sources import preparation as PR
from ..streaming import live
from . import sql
from .book_queries import REB, weights
from .panel_queries import _EFF, BINS, FWD, RIC, SIG, B, P, W_T, _r, effective, evaluated, rank_ic, signal

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


# --- calendar, statements, suspended names ----------------------------------------------------------------------------

_OD = f"{B}, c AS (SELECT DISTINCT date FROM b), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) + 40 AS date FROM orders)"


def order_dates(s: SparkSession, d: str) -> DataFrame:
    return panel.read(s, d, "orders").select(F.date_add(F.col("o_orderdate").cast("date"), 40).alias("date")).distinct()


@query("cal2_is_trading_day", _OD + " SELECT o.date, c.date IS NOT NULL AS is_session FROM o LEFT JOIN c ON o.date = c.date")
def _(s, d):
    return PR.is_session(order_dates(s, d), data.sessions(panel.bars(s, d)))


@query("cal3_previous_session", _OD + " SELECT o.date, max(c.date) AS prev FROM o LEFT JOIN c ON c.date < o.date GROUP BY o.date")
def _(s, d):
    return PR.previous_session(order_dates(s, d), data.sessions(panel.bars(s, d)))


@query("cal4_align_inner", _OD + " SELECT CAST(o_orderdate AS DATE) + 40 AS date, o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) + 40 IN (SELECT date FROM c)")
def _(s, d):
    o = panel.read(s, d, "orders").select(F.date_add(F.col("o_orderdate").cast("date"), 40).alias("date"), "o_orderkey")
    return PR.align_inner(o, data.sessions(panel.bars(s, d)))


_F = f"WITH {sql.FUNDS}, {sql.BARS}"


@query("pit1_available", _F + " SELECT ticker, report_date, publish_date, (SELECT min(date) FROM b WHERE b.date > f.publish_date + 2) AS date, round(revenue, 2) AS revenue FROM f")
def _(s, d):
    f = PR.available(panel.fundamentals(s, d), data.sessions(panel.bars(s, d)), 2)
    return f.select("ticker", "report_date", "publish_date", "date", *_r("revenue", digits=2))


@query("pit2_merge_statements", _F + """ SELECT coalesce(a.ticker, c.ticker) AS ticker, coalesce(a.report_date, c.report_date) AS report_date, coalesce(a.publish_date, c.publish_date) AS publish_date, round(net_income, 6) AS net_income, round(total_assets, 6) AS total_assets
FROM (SELECT * FROM f WHERE gross_profit > 100000) a FULL JOIN (SELECT * FROM f WHERE total_assets < 2000000) c ON a.ticker = c.ticker AND a.report_date = c.report_date AND a.publish_date = c.publish_date""".replace("a.total_assets", "total_assets").replace("round(net_income", "round(a.net_income").replace("round(total_assets", "round(c.total_assets"))
def _(s, d):
    f, keys = panel.fundamentals(s, d), ["ticker", "report_date", "publish_date"]
    parts = f.filter("gross_profit > 100000").select(*keys, "net_income"), f.filter("total_assets < 2000000").select(*keys, "total_assets")
    return PR.merge_statements(*parts).select(*keys, *_r("net_income", "total_assets", digits=6))


@query("pit3_market_cap", _F + " SELECT f.ticker, report_date, date, round(shares * close / 1000, 7) AS market_cap, round(total_equity / nullif(shares, 0), 4) AS book_per_share FROM f JOIN b ON b.ticker = f.ticker AND b.date = f.publish_date")
def _(s, d):
    j = panel.fundamentals(s, d).join(panel.bars(s, d).select("ticker", F.col("date").alias("publish_date"), "close"), ["ticker", "publish_date"])
    return PR.fill_market_cap(j).withColumn("market_cap", F.col("market_cap") / 1000).select("ticker", "report_date", F.col("publish_date").alias("date"), *_r("market_cap", digits=7), *_r("book_per_share", digits=4))


@query("pit5_cap_grid", _F + ", g AS (SELECT DISTINCT date FROM b WHERE month(date) = 12), l AS (SELECT ticker, max(shares) AS shares FROM f GROUP BY ticker) SELECT date, ticker, shares FROM g CROSS JOIN l")
def _(s, d):
    f = panel.fundamentals(s, d).groupBy("ticker").agg(F.max("shares").alias("shares"))
    return PR.cap_grid(f, panel.bars(s, d).filter(F.month("date") == 12), f)


def suspended(s: SparkSession, d: str) -> DataFrame:
    z = F.col("volume") < 20
    return panel.bars(s, d).withColumns({"is_suspended": z, "close": F.when(z, 0.0).otherwise(F.col("close"))})


_SUS = f"{B}, z AS (SELECT * EXCLUDE (close), volume < 20 AS off, CASE WHEN volume < 20 THEN 0.0 ELSE close END AS raw FROM b), k AS (SELECT *, last_value(nullif(raw, 0) IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS close FROM z)"


@query("cn2_clean_suspended", _SUS + " SELECT date, ticker, round(close, 8) AS close, CASE WHEN off THEN 0.0 ELSE volume END AS volume, round(CASE WHEN off THEN 0.0 ELSE amount END, 2) AS amount FROM k")
def _(s, d):
    return PR.clean_suspended(suspended(s, d)).select("date", "ticker", *_r("close", digits=8), "volume", *_r("amount", digits=2))


@query("cn4_new_listing", f"{B} SELECT date, ticker, date < min(date) OVER (PARTITION BY ticker) + 60 AS is_new FROM b")
def _(s, d):
    return PR.new_listing(panel.bars(s, d)).select("date", "ticker", "is_new")


@query("cn5_traded_returns", _SUS + f", r AS (SELECT date, ticker, off, close / nullif(lag(close) OVER {W_T}, 0) AS g FROM k) SELECT date, ticker, round(CASE WHEN off THEN 0 ELSE g - 1 END, 6) AS ret, round(CASE WHEN off THEN 0 WHEN g > 0 THEN ln(g) END, 6) AS log_ret FROM r")
def _(s, d):
    return PR.traded_returns(PR.clean_suspended(suspended(s, d))).select("date", "ticker", *_r("ret", "log_ret"))


@query("cn8_lots", "SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity * 37 / 100) AS BIGINT) * 100 AS cn, CAST(floor(l_quantity * 37) AS BIGINT) AS us FROM lineitem")
def _(s, d):
    x = F.col("l_quantity") * 37
    return panel.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", PR.lots(x, "cn").alias("cn"), PR.lots(x, "us").alias("us"))


# --- windows and top-k ------------------------------------------------------------------------------------------------


def _w(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_RZ = f"""{P}, z AS (SELECT date, ticker, ret, avg(ret) OVER {_w(60)} AS m, stddev_pop(ret) OVER {_w(60)} AS sd, count(*) OVER {_w(60)} AS k, count(ret) OVER {_w(60)} AS n FROM p),
y AS (SELECT date, ticker, CASE WHEN k >= 60 AND n >= 5 AND ret IS NOT NULL THEN CASE WHEN sd > 1e-12 THEN (ret - m) / sd ELSE 0 END END AS z FROM z)"""


@query("w17_rolling_z", _RZ + " SELECT date, ticker, round(z, 5) AS z FROM y")
def _(s, d):
    return panel.returns(s, d).withColumn("z", S.rolling_z(F.col("ret"), 60)).select("date", "ticker", *_r("z", digits=5))


@query("am3_momentum_signal", _RZ + " SELECT date, ticker, CASE WHEN z > 2 THEN -1.0 WHEN z < -2 THEN 1.0 ELSE 0.0 END AS signal FROM y")
def _(s, d):
    return panel.returns(s, d).withColumn("z", S.rolling_z(F.col("ret"), 60)).select("date", "ticker", S.momentum_signal(F.col("z")).alias("signal"))


@query("k1_sorted_rank", f"{P} SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY ret DESC NULLS LAST, date) AS k FROM p")
def _(s, d):
    return panel.returns(s, d).select("ticker", "date", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc_nulls_last("ret"), "date")).alias("k"))


@query("k3_best_row", f"{P} SELECT date, ticker, round(ret, 6) AS ret FROM p WHERE ret IS NOT NULL ORDER BY ret DESC, date, ticker LIMIT 1")
def _(s, d):
    return panel.returns(s, d).filter("ret is not null").orderBy(F.desc("ret"), "date", "ticker").limit(1).select("date", "ticker", *_r("ret"))


@query("k4_last_rows", f"{B} SELECT date, ticker, round(close, 8) AS close FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM b) WHERE k <= 5")
def _(s, d):
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    return panel.bars(s, d).withColumn("k", F.row_number().over(w)).filter("k <= 5").select("date", "ticker", *_r("close", digits=8))


# --- scorecards -------------------------------------------------------------------------------------------------------

_IC = RIC + f""", pc AS (SELECT date, CASE WHEN count(*) >= 5 THEN {sql.corr('x', 'f1')} END AS pic FROM u GROUP BY date), bo AS (SELECT ic.date, pic, ic FROM ic JOIN pc ON ic.date = pc.date WHERE ic IS NOT NULL OR pic IS NOT NULL)"""
_TOP = """, cu AS (SELECT date, quantile_cont(x, 0.8) AS c FROM u GROUP BY date), tp AS (SELECT u.date, ticker FROM u JOIN cu ON u.date = cu.date WHERE x >= c), tn AS (SELECT date, count(*) AS n FROM tp GROUP BY date),
to_ AS (SELECT date, n, lag(date) OVER (ORDER BY date) AS prev, lag(n) OVER (ORDER BY date) AS was FROM tn), bt AS (SELECT o.date, count(*) AS b FROM to_ o JOIN tp a ON a.date = o.date JOIN tp z ON z.date = o.prev AND z.ticker = a.ticker GROUP BY o.date),
tu AS (SELECT o.date, (n + was - 2.0 * coalesce(b, 0)) / was AS turnover FROM to_ o LEFT JOIN bt ON bt.date = o.date WHERE prev IS NOT NULL)"""


@query("sc1_cross_sectional", BINS.replace("SELECT u.date, ticker, f1", "SELECT u.date, ticker, x, f1") + f""", k AS (SELECT date, {sql.rank('x', 'date')} AS rx, {sql.rank('f1', 'date')} AS ry FROM u), ic AS (SELECT date, CASE WHEN count(*) >= 5 THEN {sql.corr('rx', 'ry')} END AS ic FROM k GROUP BY date),
pc AS (SELECT date, CASE WHEN count(*) >= 5 THEN {sql.corr('x', 'f1')} END AS pic FROM u GROUP BY date), bo AS (SELECT pic, ic FROM ic JOIN pc ON ic.date = pc.date), pb AS (SELECT bin, avg(f1) AS r FROM bn GROUP BY bin) {_TOP}
SELECT round(avg(pic), 6) AS mean_ic, round(stddev_samp(pic), 6) AS std_ic, round(avg(ic), 6) AS mean_rank_ic, round(stddev_samp(ic), 6) AS std_rank_ic, round(avg(pic) / stddev_samp(pic), 5) AS ic_ir, round(avg(ic) / stddev_samp(ic), 5) AS rank_ic_ir,
 round(avg(CASE WHEN pic > 1e-12 THEN 1.0 WHEN pic IS NOT NULL THEN 0.0 END), 6) AS hit_rate, count(pic) AS n_periods, round((SELECT arg_max(r, bin) - arg_min(r, bin) FROM pb), 6) AS monotonicity, round((SELECT avg(turnover) FROM tu), 6) AS turnover FROM bo""")
def _(s, d):
    out = S.cross_sectional(evaluated(s, d).select("date", "ticker", "x", "fwd_1"))
    return out.select(*_r("mean_ic", "std_ic", "mean_rank_ic", "std_rank_ic"), *_r("ic_ir", "rank_ic_ir", digits=5), *_r("hit_rate"), "n_periods", *_r("monotonicity", "turnover"))


@query("sc2_time_series", FWD + """, h AS (SELECT *, CASE WHEN sign(x) = sign(f1) AND x <> 0 THEN 1.0 ELSE 0.0 END AS hit FROM u), dl AS (SELECT avg(x * f1) AS r FROM h GROUP BY date), tk AS (SELECT avg(hit) AS h FROM h GROUP BY ticker)
SELECT round(avg(hit), 6) AS hit_rate, round(avg(abs(x - f1)), 6) AS mean_absolute_error, count(*) AS n, count(DISTINCT ticker) AS n_tickers, round((SELECT avg(r) / stddev_samp(r) * sqrt(252) FROM dl), 5) AS directional_sharpe, round((SELECT avg(h) FROM tk), 6) AS ticker_hit_rate FROM h""")
def _(s, d):
    return S.time_series(evaluated(s, d)).select(*_r("hit_rate", "mean_absolute_error"), "n", "n_tickers", *_r("directional_sharpe", digits=5), *_r("ticker_hit_rate"))


@query("sc3_regime", f"""{P}, m AS (SELECT date, avg(ret) AS mkt FROM p GROUP BY date), pr AS (SELECT date, avg(CASE WHEN ret < 0 THEN 0.875 ELSE 0.25 END) AS p FROM p WHERE ret IS NOT NULL GROUP BY date),
j AS (SELECT m.date, mkt, CASE WHEN p > 0.5 THEN 1 - p ELSE 1.0 END AS share, CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END AS high FROM m JOIN pr ON m.date = pr.date WHERE mkt IS NOT NULL),
v AS (SELECT *, mkt * share AS ov, exp(sum(ln(1 + greatest(mkt, -0.999999))) OVER o) AS a, exp(sum(ln(1 + greatest(mkt * share, -0.999999))) OVER o) AS c FROM j WINDOW o AS (ORDER BY date ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, a / max(a) OVER o - 1 AS da, c / max(c) OVER o - 1 AS dc FROM v WINDOW o AS (ORDER BY date ROWS UNBOUNDED PRECEDING))
SELECT round(avg(mkt) / stddev_samp(mkt) * sqrt(252), 5) AS baseline_sharpe, round(avg(ov) / stddev_samp(ov) * sqrt(252), 5) AS overlay_sharpe, round(abs(min(da)), 6) AS baseline_max_dd, round(abs(min(dc)), 6) AS overlay_max_dd, round(avg(high), 6) AS detection_rate, round(avg(1 - share), 6) AS exposure_reduction, count(*) AS n_periods FROM d""")
def _(s, d):
    p = panel.returns(s, d).select("date", "ret")
    prob = p.filter("ret is not null").select("date", F.when(F.col("ret") < 0, 0.875).otherwise(0.25).alias("prob"))
    out = S.regime(panel.market(p), prob)
    return out.select(*_r("baseline_sharpe", "overlay_sharpe", digits=5), *_r("baseline_max_dd", "overlay_max_dd", "detection_rate", "exposure_reduction"), "n_periods")


@query("sc4_half_life", f"""{P}, l AS (SELECT ticker, close AS a, lag(close) OVER {W_T} AS b FROM p), r AS (SELECT ticker, count(*) AS n, {sql.corr('a', 'b')} AS rho FROM l WHERE b IS NOT NULL GROUP BY ticker HAVING count(*) >= 29)
SELECT ticker, n, round(rho, 6) AS rho, round(rho * rho, 6) AS r2, round(CASE WHEN rho > 0 AND rho < 1 THEN -ln(2) / ln(rho) END, 5) AS half_life FROM r""")
def _(s, d):
    return S.half_life(panel.bars(s, d), "close").select("ticker", "n", *_r("rho", "r2"), *_r("half_life", digits=5))


_TS = FWD + f", c AS (SELECT ticker, count(*) AS n, {sql.corr('x', 'f1')} AS corr FROM u GROUP BY ticker HAVING count(*) >= 30)"


@query("ev16_per_stock", _TS + " SELECT ticker, n, round(corr, 6) AS corr FROM c")
def _(s, d):
    return S.per_stock(evaluated(s, d)).select("ticker", "n", *_r("corr"))


@query("ev16_signal_summary", _TS + " SELECT round(avg(corr), 6) AS mean_ts_corr, round(quantile_cont(corr, 0.5), 6) AS median_ts_corr, round(avg(CASE WHEN corr > 1e-12 THEN 1.0 WHEN corr IS NOT NULL THEN 0.0 END), 6) AS share_positive, count(*) AS n_stocks FROM c")
def _(s, d):
    return S.signal_summary(evaluated(s, d)).select(*_r("mean_ts_corr", "median_ts_corr", "share_positive"), "n_stocks")


@query("ev16_hit_rates", SIG + f""", l AS (SELECT x.ticker, ret, lag(x) OVER (PARTITION BY x.ticker ORDER BY x.date) AS g FROM x JOIN p ON x.date = p.date AND x.ticker = p.ticker), y AS (SELECT * FROM l WHERE g IS NOT NULL AND ret IS NOT NULL)
SELECT ticker, round(CASE WHEN count(*) >= 10 THEN avg(CASE WHEN sign(g) = sign(ret) THEN 1.0 ELSE 0.0 END) END, 6) AS accuracy, round(CASE WHEN count(*) FILTER (g > 0.1) > 5 THEN avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) FILTER (g > 0.1) END, 6) AS long_hit,
 round(CASE WHEN count(*) FILTER (g < -0.1) > 5 THEN avg(CASE WHEN ret < 0 THEN 1.0 ELSE 0.0 END) FILTER (g < -0.1) END, 6) AS short_hit, count(*) FILTER (g > 0.1) AS n_long, count(*) FILTER (g < -0.1) AS n_short FROM y GROUP BY ticker""")
def _(s, d):
    j = signal(s, d).join(panel.returns(s, d).select("date", "ticker", "ret"), ["date", "ticker"])
    return S.hit_rates(j, "x", "ret", 0.1).select("ticker", *_r("accuracy", "long_hit", "short_hit"), "n_long", "n_short")


# --- many factors -----------------------------------------------------------------------------------------------------


def long_frame(s: SparkSession, d: str) -> DataFrame:
    fwd = E.forward_returns(panel.returns(s, d), (1, 5)).select("date", "ticker", "fwd_1", "fwd_5")
    return effective(s, d).join(fwd, ["date", "ticker"])


_LONG = _EFF + f""", fw AS (SELECT date, ticker, lead(close, 1) OVER {W_T} / nullif(close, 0) - 1 AS f1, lead(close, 5) OVER {W_T} / nullif(close, 0) - 1 AS f5 FROM p),
lg AS (SELECT e.date, e.ticker, factor, value, f1, f5 FROM e JOIN fw ON e.date = fw.date AND e.ticker = fw.ticker),
up AS (SELECT date, ticker, factor, value, 1 AS h, f1 AS fwd FROM lg WHERE f1 IS NOT NULL AND value IS NOT NULL UNION ALL SELECT date, ticker, factor, value, 5, f5 FROM lg WHERE f5 IS NOT NULL AND value IS NOT NULL),
rk AS (SELECT *, {sql.rank('value', 'factor, h, date')} AS a, {sql.rank('fwd', 'factor, h, date')} AS b FROM up),
ics AS (SELECT factor, h, date, CASE WHEN count(*) >= 5 THEN {sql.corr('value', 'fwd')} END AS ic, CASE WHEN count(*) >= 5 THEN {sql.corr('a', 'b')} END AS ric FROM rk GROUP BY 1, 2, 3),
im AS (SELECT factor, h, avg(ic) AS ic_mean, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)) AS ic_t, avg(ric) AS ric_mean, avg(ric) / nullif(stddev_samp(ric), 0) * sqrt(count(ric)) AS ric_t FROM ics GROUP BY 1, 2),
ed AS (SELECT factor, h, date, quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) AS e FROM up GROUP BY 1, 2, 3),
bi AS (SELECT up.factor, up.h, up.date, len(list_filter(list_distinct(e), lambda v: v < value)) + 1 AS bin, avg(fwd) AS ret FROM up JOIN ed ON up.factor = ed.factor AND up.h = ed.h AND up.date = ed.date GROUP BY 1, 2, 3, 4),
ls AS (SELECT factor, h, date, max(CASE WHEN bin = 5 THEN ret END) - max(CASE WHEN bin = 1 THEN ret END) AS ls FROM bi GROUP BY 1, 2, 3), lm AS (SELECT factor, h, avg(ls) AS m, stddev_samp(ls) AS sd FROM ls GROUP BY 1, 2),
bm AS (SELECT factor, h, bin, avg(ret) AS r FROM bi GROUP BY 1, 2, 3), br AS (SELECT factor, h, {sql.rank('bin', 'factor, h')} AS a, {sql.rank('r', 'factor, h')} AS b FROM bm), mo AS (SELECT factor, h, CASE WHEN count(*) >= 3 THEN {sql.corr('a', 'b')} END AS mono FROM br GROUP BY 1, 2)"""


@query("ev9_horizons", _LONG + " SELECT im.factor, im.h, round(ic_mean, 6) AS ic_mean, round(ic_t, 5) AS ic_t, round(ric_mean, 6) AS ric_mean, round(ric_t, 5) AS ric_t, round(m / nullif(sd, 0) * sqrt(252.0 / im.h), 5) AS ls_sharpe, round(mono, 6) AS monotonicity FROM im JOIN lm ON im.factor = lm.factor AND im.h = lm.h LEFT JOIN mo ON im.factor = mo.factor AND im.h = mo.h")
def _(s, d):
    return S.horizons(long_frame(s, d), (1, 5)).select("factor", "h", *_r("ic_mean"), *_r("ic_t", digits=5), *_r("ric_mean"), *_r("ric_t", "ls_sharpe", digits=5), *_r("monotonicity"))


_TURN = f""", od AS (SELECT factor, date, lag(date) OVER (PARTITION BY factor ORDER BY date) AS prev FROM (SELECT DISTINCT factor, date FROM lg WHERE value IS NOT NULL)),
tt AS (SELECT x.factor, x.date, x.value AS a, y.value AS b FROM lg x JOIN od ON x.factor = od.factor AND x.date = od.date JOIN lg y ON y.factor = x.factor AND y.date = od.prev AND y.ticker = x.ticker WHERE x.value IS NOT NULL AND y.value IS NOT NULL),
tr AS (SELECT factor, date, {sql.rank('a', 'factor, date')} AS a, {sql.rank('b', 'factor, date')} AS b FROM tt), td AS (SELECT factor, date, CASE WHEN count(*) >= 5 THEN 1 - {sql.corr('a', 'b')} END AS t FROM tr GROUP BY 1, 2), tm AS (SELECT factor, avg(t) AS tm FROM td GROUP BY 1)"""


@query("ev15_compare_factors", _LONG + _TURN + """, sg AS (SELECT factor, greatest(count(*) FILTER (ric_mean > 0), count(*) FILTER (ric_mean < 0)) * 1.0 / nullif(count(*) FILTER (ric_mean <> 0), 0) AS sc FROM im GROUP BY 1)
SELECT im.factor, round(ic_mean, 6) AS ic_mean, round(ric_mean, 6) AS ric_mean, round(ric_t, 5) AS ric_t, round(m / nullif(sd, 0) * sqrt(252), 5) AS ls_sharpe, round(mono, 6) AS monotonicity, round(tm, 6) AS mean_turnover, round(m - coalesce(tm, 0) * 10 / 10000, 6) AS net_ls_mean,
 round((m - coalesce(tm, 0) * 10 / 10000) / nullif(sd, 0) * sqrt(252), 5) AS net_ls_sharpe, round(m / greatest(tm, 1e-12) * 10000, 3) AS break_even_bps, round(sc, 6) AS sign_consistency
FROM im JOIN lm ON im.factor = lm.factor AND im.h = lm.h LEFT JOIN mo ON im.factor = mo.factor AND im.h = mo.h LEFT JOIN tm ON im.factor = tm.factor JOIN sg ON im.factor = sg.factor WHERE im.h = 1""")
def _(s, d):
    out = S.tear_sheet(long_frame(s, d), (1, 5))
    return out.select("factor", *_r("ic_mean", "ric_mean"), *_r("ric_t", "ls_sharpe", digits=5), *_r("monotonicity", "mean_turnover", "net_ls_mean"), *_r("net_ls_sharpe", digits=5), *_r("break_even_bps", digits=3), *_r("sign_consistency"))


_FOLDS = """, rr AS (SELECT date_trunc('month', min(date)) AS lo, max(date) AS hi FROM p), kk AS (SELECT lo, unnest(range(0, 20)) AS fold, hi FROM rr),
fo AS (SELECT CAST(fold AS INTEGER) AS fold, lo + to_months(CAST(fold * 12 AS INTEGER)) AS a, lo + to_months(CAST(fold * 12 + 36 AS INTEGER)) AS b, lo + to_months(CAST(fold * 12 + 48 AS INTEGER)) AS c FROM kk WHERE lo + to_months(CAST(fold * 12 + 36 AS INTEGER)) <= hi)"""


@query("ev14_oos_stability", RIC + _FOLDS + ", t AS (SELECT fold, avg(ic) AS m FROM ic JOIN fo ON date >= b AND date < c GROUP BY fold) SELECT round(avg(m), 6) AS oos_mean, round(stddev_samp(m), 6) AS oos_sd, round(avg(CASE WHEN m > 1e-12 THEN 1.0 WHEN m IS NOT NULL THEN 0.0 END), 6) AS oos_positive, count(*) AS folds FROM t")
def _(s, d):
    return S.oos_stability(rank_ic(s, d), N.folds(panel.bars(s, d))).select(*_r("oos_mean", "oos_sd", "oos_positive"), "folds")


_SEL = _LONG + _FOLDS + ", fs AS (SELECT fold, factor, avg(ric) AS m FROM ics JOIN fo ON date >= a AND date < b WHERE h = 1 GROUP BY 1, 2), ch AS (SELECT fold, factor, m, row_number() OVER (PARTITION BY fold ORDER BY m DESC NULLS LAST, factor) AS k FROM fs)"


def chosen(s: SparkSession, d: str) -> DataFrame:
    ic = E.ic_series(long_frame(s, d), "value", "fwd_1", by=("date", "factor"))
    return S.select_per_fold(ic, N.folds(panel.bars(s, d)), 1)


@query("wf3_selected_factors", _SEL + " SELECT fold, factor, round(m, 6) AS mean_ic, k AS rank FROM ch WHERE k <= 1")
def _(s, d):
    return chosen(s, d).select("fold", "factor", *_r("mean_ic"), "rank")


@query("wf2_fold_portfolios", _SEL + """, te AS (SELECT fo.fold, date, ticker, avg(value) AS v, min(f1) AS r FROM lg JOIN fo ON date >= b AND date < c JOIN ch ON ch.fold = fo.fold AND ch.factor = lg.factor AND k <= 1 WHERE value IS NOT NULL GROUP BY 1, 2, 3),
tq AS (SELECT fold, date, quantile_cont(v, 0.8) AS q, count(*) AS n FROM te WHERE r IS NOT NULL GROUP BY 1, 2), dy AS (SELECT te.fold, te.date, avg(r) AS r FROM te JOIN tq ON te.fold = tq.fold AND te.date = tq.date WHERE r IS NOT NULL AND v >= q AND n >= 10 GROUP BY 1, 2),
nv AS (SELECT *, exp(sum(ln(1 + r)) OVER o) AS nav FROM dy WINDOW o AS (PARTITION BY fold ORDER BY date ROWS UNBOUNDED PRECEDING)), dd AS (SELECT *, nav / greatest(max(nav) OVER (PARTITION BY fold ORDER BY date ROWS UNBOUNDED PRECEDING), 1) - 1 AS d FROM nv)
SELECT fold, count(*) AS n, round(exp(sum(ln(1 + r)) * 252.0 / count(*)) - 1, 4) AS ann_return, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 5) AS sharpe, round(min(d), 6) AS max_drawdown FROM dd GROUP BY fold""")
def _(s, d):
    f = N.folds(panel.bars(s, d))
    return S.fold_portfolios(long_frame(s, d), f, chosen(s, d)).select("fold", "n", *_r("ann_return", digits=4), *_r("sharpe", digits=5), *_r("max_drawdown"))


@query("rd4_long_short_panel", _LONG + " SELECT factor, date, round(ls, 6) AS ls FROM ls WHERE h = 1")
def _(s, d):
    return S.long_short_panel(long_frame(s, d)).select("factor", "date", *_r("ls"))


@query("rd4_long_short_correlation", _LONG + f" SELECT x.factor AS f1, y.factor AS f2, round({sql.corr('x.ls', 'y.ls')}, 6) AS corr FROM ls x JOIN ls y ON x.date = y.date AND x.h = 1 AND y.h = 1 AND x.factor < y.factor WHERE x.ls IS NOT NULL AND y.ls IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    return S.panel_correlation(S.long_short_panel(long_frame(s, d))).select("f1", "f2", *_r("corr"))


@query("pe14_date_correlation", _EFF + f""", pr AS (SELECT x.date, x.factor AS f1, y.factor AS f2, x.value AS u, y.value AS v FROM e x JOIN e y ON x.date = y.date AND x.ticker = y.ticker AND x.factor < y.factor WHERE x.value IS NOT NULL AND y.value IS NOT NULL),
k AS (SELECT date, f1, f2, {sql.rank('u', 'f1, f2, date')} AS a, {sql.rank('v', 'f1, f2, date')} AS b FROM pr), c AS (SELECT date, f1, f2, CASE WHEN count(*) >= 10 THEN {sql.corr('a', 'b')} END AS c FROM k GROUP BY 1, 2, 3) SELECT f1, f2, round(avg(c), 6) AS corr, count(c) AS n FROM c GROUP BY 1, 2""")
def _(s, d):
    return S.date_correlation(effective(s, d)).select("f1", "f2", *_r("corr"), "n")


@query("se3_deflated_sharpe", _LONG + " SELECT factor, round(m / nullif(sd, 0) * sqrt(252) - sqrt(2 * ln(count(*) OVER ())) / sqrt(252), 5) AS deflated FROM lm WHERE h = 1")
def _(s, d):
    return S.deflated_long_short(S.horizons(long_frame(s, d), (1, 5)).filter("h = 1")).select("factor", *_r("deflated", digits=5))


def _tests(s: SparkSession, d: str) -> DataFrame:
    """One row a ticker: a rough p-value of the sign of its mean return."""
    p = panel.returns(s, d).filter("ret is not null").groupBy(F.col("ticker").alias("factor"))
    t = F.abs(F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.count("ret")))
    return p.agg(F.exp(-t).alias("p"))


@query("se1_adjusted_p", f"""{P}, t AS (SELECT ticker AS factor, exp(-abs(avg(ret) / stddev_samp(ret) * sqrt(count(ret)))) AS p FROM p WHERE ret IS NOT NULL GROUP BY 1), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, factor) AS k FROM t)
SELECT factor, round(p, 8) AS p, round(least(1, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS bh, round(least(1, p * m), 6) AS bonferroni FROM r""")
def _(s, d):
    return A.adjust_p(_tests(s, d)).select("factor", *_r("p", digits=8), *_r("bh", "bonferroni"))


@query("se5_deployable", _LONG + """, t AS (SELECT im.factor, CASE WHEN abs(ric_t) >= 2 THEN 1 ELSE 0 END + CASE WHEN ric_mean >= 0.01 THEN 1 ELSE 0 END + CASE WHEN m >= 0 THEN 1 ELSE 0 END AS n FROM im JOIN lm ON im.factor = lm.factor AND im.h = lm.h WHERE im.h = 1)
SELECT factor, n AS passes, round(n / 3.0, 6) AS score, n = 3 AS deployable FROM t""")
def _(s, d):
    h = S.horizons(long_frame(s, d), (1, 5)).filter("h = 1").withColumn("t", F.abs("ric_t"))
    return A.deployable(h, {"t": (">=", 2.0), "ric_mean": (">=", 0.01), "ls_mean": (">=", 0.0)}).select("factor", "passes", *_r("score"), "deployable")


# --- alphas, spreads, returns -----------------------------------------------------------------------------------------


@query("am4_ensemble", _EFF + """ SELECT coalesce(x.date, y.date) AS date, coalesce(x.ticker, y.ticker) AS ticker, round(0.6 * coalesce(x.value, 0) + 0.4 * coalesce(y.value, 0), 6) AS alpha FROM (SELECT * FROM e WHERE factor = 'STR_1W') x
FULL JOIN (SELECT * FROM e WHERE factor = 'MOM_1M') y ON x.date = y.date AND x.ticker = y.ticker""")
def _(s, d):
    e = effective(s, d).withColumnRenamed("value", "score")
    return S.ensemble(e.filter("factor = 'STR_1W'"), e.filter("factor = 'MOM_1M'")).select("date", "ticker", *_r("alpha"))


@query("am5_overlay", SIG + ", pr AS (SELECT date, avg(CASE WHEN ret < 0 THEN 0.875 ELSE 0.25 END) AS q FROM p WHERE ret IS NOT NULL GROUP BY date) SELECT x.date, ticker, round(CASE WHEN q > 0.6 THEN x * 0.5 ELSE x END, 6) AS x FROM x LEFT JOIN pr ON x.date = pr.date")
def _(s, d):
    prob = panel.returns(s, d).filter("ret is not null").select("date", F.when(F.col("ret") < 0, 0.875).otherwise(0.25).alias("prob"))
    return A.overlay(signal(s, d), prob, "x").select("date", "ticker", *_r("x"))


@query("mv3_alpha_spread", SIG + """, l AS (SELECT x.date, ret, lag(x) OVER (PARTITION BY x.ticker ORDER BY x.date) AS g FROM x JOIN p ON x.date = p.date AND x.ticker = p.ticker), y AS (SELECT * FROM l WHERE g IS NOT NULL AND ret IS NOT NULL),
c AS (SELECT date, quantile_cont(g, 0.8) AS hi, quantile_cont(g, 0.2) AS lo FROM y GROUP BY date) SELECT y.date, count(*) AS n, round(avg(ret) FILTER (g >= hi) - avg(ret) FILTER (g <= lo), 6) AS spread FROM y JOIN c ON y.date = c.date GROUP BY y.date HAVING count(*) >= 10""")
def _(s, d):
    j = signal(s, d).join(panel.returns(s, d).select("date", "ticker", "ret"), ["date", "ticker"])
    return S.spread(j, "x", "ret").select("date", "n", *_r("spread"))


_TWO = f"{P}, j AS (SELECT date, sum(ret * amount) / sum(CASE WHEN ret IS NOT NULL THEN amount END) AS ret, avg(ret) AS mkt FROM p GROUP BY date HAVING avg(ret) IS NOT NULL)"


def whole_book(s: SparkSession, d: str) -> DataFrame:
    """The money-weighted return of all names, and their plain mean."""
    p = panel.returns(s, d)
    return p.groupBy("date").agg((F.sum(F.col("ret") * F.col("amount")) / F.sum(F.when(F.col("ret").isNotNull(), F.col("amount")))).alias("ret"), F.avg("ret").alias("mkt")).dropna()


_CALM = _TWO.replace(", j AS", ", j0 AS") + ", j AS (SELECT date, least(greatest(ret, -0.03), 0.03) AS ret, least(greatest(mkt, -0.03), 0.03) AS mkt FROM j0)"


@query("pe11_return_decomposition", _CALM + """, a AS (SELECT exp(sum(ln(1 + ret)) * 252.0 / count(*)) - 1 AS t, exp(sum(ln(1 + mkt)) * 252.0 / count(*)) - 1 AS b, covar_samp(ret, mkt) / var_samp(mkt) AS beta, avg(ret) AS mr, avg(mkt) AS mm FROM j)
SELECT round(t, 4) AS total_return, round(b, 4) AS benchmark_return, round(beta, 6) AS beta, round((mr - beta * mm) * 252, 5) AS alpha_contribution, round(beta * b, 4) AS beta_contribution, round(t - beta * b - (mr - beta * mm) * 252, 4) AS residual_contribution, round(t - b, 4) AS active_return FROM a""")
def _(s, d):
    calm = lambda x: F.least(F.greatest(F.col(x), F.lit(-0.03)), F.lit(0.03)).alias(x)
    out = S.decompose_return(whole_book(s, d).select("date", calm("ret"), calm("mkt")))
    return out.select(*_r("total_return", "benchmark_return", digits=4), *_r("beta"), *_r("alpha_contribution", digits=5), *_r("beta_contribution", "residual_contribution", "active_return", digits=4))


@query("pe4_cornish_fisher", _TWO + """, m AS (SELECT count(ret) AS n, avg(ret) AS a, stddev_samp(ret) AS sd, skewness(ret) AS s, kurtosis(ret) AS k, -1.6448536269514722 AS z FROM j)
SELECT n, round(greatest(0, -(a + sd * (z + (z * z - 1) * s / 6 + (z ** 3 - 3 * z) * k / 24 - (2 * z ** 3 - 5 * z) * s * s / 36))), 5) AS var_cornish FROM m""")
def _(s, d):
    return N.risk_summary(whole_book(s, d).select("date", "ret")).select("n", *_r("var_cornish", digits=5))


@query("pe8_capm_tests", _TWO + """, a AS (SELECT count(*) AS n, regr_slope(ret, mkt) AS beta, regr_intercept(ret, mkt) AS alpha, regr_syy(ret, mkt) * (1 - regr_r2(ret, mkt)) / (count(*) - 2) AS s2, avg(mkt) AS mm, var_samp(mkt) AS vv, avg(ret - mkt) * 252 AS ar, stddev_samp(ret - mkt) * sqrt(252) AS te FROM j)
SELECT n, round(alpha / sqrt(s2 * (1.0 / n + mm * mm / (n * vv))), 4) AS t_alpha, round(beta / sqrt(s2 / (n * vv)), 3) AS t_beta, round(ar, 5) AS active_return, round(ar / te, 5) AS information_ratio, round(sqrt(s2) * sqrt(252), 5) AS residual_vol FROM a""")
def _(s, d):
    out = N.benchmark_stats(whole_book(s, d))
    return out.select("n", *_r("t_alpha", digits=4), *_r("t_beta", digits=3), *_r("active_return", "information_ratio", "residual_vol", digits=5))


@query("pf5_cap_weights", REB + ", lq AS (SELECT wl.date, wl.ticker, p.amount AS a FROM wl JOIN p ON p.date = wl.date AND p.ticker = wl.ticker) SELECT date, ticker, round(greatest(a, 1) / sum(greatest(a, 1)) OVER (PARTITION BY date), 6) AS weight FROM lq")
def _(s, d):
    w = weights(s, d, short=False).select("date", "ticker", F.lit(1).alias("side")).join(panel.bars(s, d).select("date", "ticker", "amount"), ["date", "ticker"])
    return PF.weigh(w, PF.cap_weight("amount")).select("date", "ticker", *_r("weight"))


@query("pf15_violations", REB + " SELECT date, round(sum(weight), 6) AS total FROM wl GROUP BY date HAVING abs(sum(weight) - 1) > 1e-6 OR min(weight) < 0 OR sum(abs(weight)) > 2")
def _(s, d):
    bad = PF.violations(weights(s, d, short=False))
    return weights(s, d, short=False).join(bad.select("date").distinct(), "date", "left_semi").groupBy("date").agg(F.round(F.sum("weight"), 6).alias("total"))


@query("pf17_regime_exposure", REB + ", ex AS (SELECT date, CASE WHEN month(date) <= 6 THEN 0.5 ELSE 1.0 END AS g FROM (SELECT DISTINCT date FROM wl)) SELECT wl.date, ticker, round(weight * g, 8) AS weight FROM wl JOIN ex ON wl.date = ex.date")
def _(s, d):
    w = weights(s, d, short=False)
    ex = w.select("date").distinct().withColumn("net_exposure", F.when(F.month("date") <= 6, 0.5).otherwise(1.0))
    return PF.regime_exposure(w, ex).select("date", "ticker", *_r("weight", digits=8))


# --- costs, risk, shared features, live positions ---------------------------------------------------------------------


def priced(s: SparkSession, d: str) -> DataFrame:
    p = panel.returns(s, d)
    return p.select("date", "ticker", "close", F.avg("volume").over(W.last_rows(20)).alias("adv"), F.stddev_samp("ret").over(W.last_rows(20)).alias("vol"))


@query("ab1_cost_ablation", REB + f""", pr AS (SELECT date, ticker, close, avg(volume) OVER {_w(20)} AS adv, stddev_samp(ret) OVER {_w(20)} AS vol FROM p), o AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM wl)),
ol AS (SELECT o.nxt AS date, ticker, weight FROM wl JOIN o ON wl.date = o.date WHERE o.nxt IS NOT NULL), ch AS (SELECT coalesce(wl.date, ol.date) AS date, coalesce(wl.ticker, ol.ticker) AS ticker, coalesce(wl.weight, 0) - coalesce(ol.weight, 0) AS delta FROM wl FULL JOIN ol ON wl.date = ol.date AND wl.ticker = ol.ticker),
t AS (SELECT delta, round_even(abs(delta) * 1e6 / close, 0) AS sh, close, coalesce(adv, 1e6) AS adv, coalesce(vol, 0.02) AS vol FROM ch JOIN pr ON ch.date = pr.date AND ch.ticker = pr.ticker WHERE abs(delta) > 1e-10 AND close > 0),
n AS (SELECT *, sh * close AS n FROM t WHERE sh > 0), k AS (SELECT n, delta, greatest(sh * 0.005, 1) AS com, n * 0.0005 AS slip, 0.1 * vol * sqrt(sh / greatest(adv, 1)) * n AS imp, CASE WHEN delta < 0 THEN n * 8e-6 + sh * 1.19e-4 ELSE 0 END AS fee FROM n)
SELECT 'full' AS model, count(*) AS trades, round(sum(com + slip + imp + fee), 0) AS cost FROM k UNION ALL SELECT 'no_impact', count(*), round(sum(com + slip + fee), 0) FROM k UNION ALL SELECT 'no_slippage', count(*), round(sum(com + imp + fee), 0) FROM k""")
def _(s, d):
    models = {"full": C.CostModel(), "no_impact": C.CostModel(impact=0.0), "no_slippage": C.CostModel(slippage_bps=0.0)}
    return S.cost_ablation(weights(s, d, short=False), priced(s, d), models).select("model", "trades", F.round("cost", 0).alias("cost"))


_VAR = _TWO + """, v AS (SELECT date, ret, CASE WHEN count(ret) OVER o >= 126 THEN greatest(0, -quantile_cont(ret, 0.05) OVER o) END AS var FROM j WINDOW o AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)), l AS (SELECT date, ret, lag(var) OVER (ORDER BY date) AS var FROM v),
c AS (SELECT count(*) AS n, count(*) FILTER (ret < -var) AS k FROM l WHERE var IS NOT NULL AND ret IS NOT NULL)"""


@query("pe6_var_backtest", _VAR + " SELECT n, k AS breaches, round(k / n, 6) AS rate, round(greatest(0, -2 * ((n - k) * ln(0.95) + k * ln(0.05) - (n - k) * ln(greatest(1 - k / n, 1e-300)) - k * ln(greatest(k / n, 1e-300)))), 4) AS lr FROM c")
def _(s, d):
    return S.var_backtest(N.rolling_var(whole_book(s, d).select("date", "ret"))).select("n", "breaches", *_r("rate"), *_r("lr", digits=4))


@query("w10_back_fill", _SUS.replace("last_value(nullif(raw, 0) IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)", "first_value(nullif(raw, 0) IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)") + " SELECT date, ticker, round(close, 8) AS close FROM k")
def _(s, d):
    return suspended(s, d).withColumn("close", W.backward_fill(F.nullif(F.col("close"), F.lit(0.0)))).select("date", "ticker", *_r("close", digits=8))


@query("am9_orthogonal", _EFF + """, j AS (SELECT y.date, y.ticker, x.value AS b, y.value AS v FROM (SELECT * FROM e WHERE factor = 'STR_1W') x JOIN (SELECT * FROM e WHERE factor = 'MOM_1M') y ON x.date = y.date AND x.ticker = y.ticker),
rg AS (SELECT date, regr_slope(v, b) AS s, regr_intercept(v, b) AS i, count(*) AS n FROM j GROUP BY date) SELECT j.date, ticker, round(v - i - s * b, 9) AS value FROM j JOIN rg ON j.date = rg.date WHERE n >= 10 AND s IS NOT NULL""")
def _(s, d):
    e = effective(s, d)
    return S.orthogonal(e.filter("factor = 'MOM_1M'"), e.filter("factor = 'STR_1W'")).select("date", "ticker", *_r("value", digits=9))


@query("am10_regime_policy", _EFF + """ SELECT date, ticker, factor, round(value * CASE WHEN month(date) <= 6 THEN 0.5 ELSE 1 END, 6) AS value FROM e WHERE NOT (factor = 'MOM_1M' AND month(date) <= 6) """)
def _(s, d):
    e = effective(s, d)
    controls = e.select("date").distinct().filter(F.month("date") <= 6).select("date", F.array(F.lit("MOM_1M")).alias("disabled"), F.lit(0.5).alias("multiplier"))
    return S.regime_policy(e, controls).select("date", "ticker", "factor", *_r("value"))


@query("rm4_contributions", REB + """, m AS (SELECT date, avg(ret) AS mkt FROM p GROUP BY date), x1 AS (SELECT p.ticker, regr_slope(ret, mkt) AS beta, sqrt(greatest(regr_syy(ret, mkt) * (1 - regr_r2(ret, mkt)), 0) / (count(*) - 1) * 252) AS sp FROM p JOIN m ON p.date = m.date WHERE ret IS NOT NULL AND mkt IS NOT NULL GROUP BY 1 HAVING count(*) >= 20),
j AS (SELECT date, wl.ticker, weight, beta, sp, sum(weight * beta) OVER (PARTITION BY date) AS ex FROM wl JOIN x1 ON wl.ticker = x1.ticker), c AS (SELECT *, weight * beta * ex * 0.04 + weight * weight * sp * sp AS c FROM j)
SELECT date, ticker, round(c / sqrt(sum(c) OVER (PARTITION BY date)), 5) AS contribution FROM c""")
def _(s, d):
    p = panel.returns(s, d)
    model = risk_model.exposures(p.join(panel.market(p), "date"))
    return risk_model.contributions(weights(s, d, short=False), model, 0.04).select("date", "ticker", *_r("contribution", digits=5))


@query("fc1_features", f"""{P} SELECT date, ticker, round(abs(ret), 6) AS abs_ret, round(close / nullif(lag(close, 5) OVER {W_T}, 0) - 1, 6) AS ret_5, round(close * volume, 4) AS dollar_volume, round(avg(ret) OVER (PARTITION BY date), 6) AS market_ret, round({sql.roll('stddev_samp(?)', 'ret', 20, 10)}, 6) AS vol_20,
round({sql.roll('avg(?)', 'volume', 20, 10)}, 6) AS volume_mean_20, round(max(high) OVER {_w(2)}, 8) AS high_2, round(min(low) OVER {_w(2)}, 8) AS low_2 FROM p""")
def _(s, d):
    f = S.features(panel.returns(s, d))
    return f.select("date", "ticker", *_r("abs_ret", "ret_5"), *_r("dollar_volume", digits=4), *_r("market_ret", "vol_20", "volume_mean_20"), *_r("high_2", "low_2", digits=8))


_FILL = "WITH e AS (SELECT event_id, event_type AS symbol, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END * (event_id % 50 + 1) AS shares, abs(value) AS price FROM events)"


def fills(s: SparkSession, d: str) -> DataFrame:
    n = F.when(F.col("event_id") % 3 == 0, -1).otherwise(1) * (F.col("event_id") % 50 + 1)
    return panel.read(s, d, "events").select("event_id", F.col("event_type").alias("symbol"), n.alias("shares"), F.abs("value").alias("price"))


@query("st9_positions", _FILL + " SELECT symbol, CAST(sum(shares) AS BIGINT) AS position, round(sum(shares * price) FILTER (shares > 0) / sum(shares) FILTER (shares > 0), 6) AS average_cost FROM e GROUP BY symbol")
def _(s, d):
    return live.positions(fills(s, d)).select("symbol", "position", *_r("average_cost"))


@query("st9_exposure", _FILL + ", q AS (SELECT symbol, sum(shares) AS n, arg_max(price, event_id) AS px FROM e GROUP BY symbol) SELECT round(sum(n * px), 4) AS net, round(sum(abs(n * px)), 4) AS gross FROM q")
def _(s, d):
    f = fills(s, d)
    return live.exposure(live.positions(f), f.groupBy("symbol").agg(F.max_by("price", "event_id").alias("price"))).select(*_r("net", "gross", digits=4))


@query("st7_limit_orders", _FILL + " SELECT event_id, symbol, CASE WHEN shares > 0 THEN 'buy' ELSE 'sell' END AS side, CAST(abs(shares) AS BIGINT) AS quantity, floor(price * (1 + CASE WHEN shares > 0 THEN 0.001 ELSE -0.001 END) * 100) / 100 AS limit_price FROM e WHERE price > 0")
def _(s, d):
    return live.orders(fills(s, d).filter("price > 0"), "LMT", 10.0).select("event_id", "symbol", "side", "quantity", "limit_price")
