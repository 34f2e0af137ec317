"""Queries of sources, panel preparation, joins, aggregates, windows, transforms and evaluation, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import evaluation as E
from ..operators import factors
from ..operators import transforms as X
from ..sources import data, panel
from . import sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
P, B = f"WITH {sql.PANEL}", f"WITH {sql.BARS}"
W_T = "(PARTITION BY ticker ORDER BY date)"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def _r(*names: str, digits: int = 6) -> list:
    return [F.round(n, digits).alias(n) for n in names]


# --- sources and panel ------------------------------------------------------------------------------------------------


@query("src1_load_columns", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def _(s, d):
    return data.load(s, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"]).filter("l_quantity > 45")


@query("src13_benchmark_returns", f"{P} SELECT date, round(avg(ret), 6) AS mkt FROM p GROUP BY date")
def _(s, d):
    return panel.market(panel.returns(s, d)).select("date", *_r("mkt"))


@query("src14_upsert", f"""{B}, n AS (SELECT date, ticker, close * 0.95 AS close FROM b WHERE month(date) = 12)
SELECT coalesce(n.date, b.date) AS date, coalesce(n.ticker, b.ticker) AS ticker, round(coalesce(n.close, b.close), 10) AS close FROM b FULL JOIN n ON b.date = n.date AND b.ticker = n.ticker""")
def _(s, d):
    old = panel.bars(s, d).select("date", "ticker", "close")
    new = old.filter(F.month("date") == 12).withColumn("close", F.col("close") * 0.95)
    return data.upsert(old, new).select("date", "ticker", *_r("close", digits=10))


@query("src16_manifest")
def _(s, d):
    return data.manifest(panel.read(s, d, "orders"), "orders")


@query("src18_quality_report", f"{P} SELECT count(*) AS n, count(DISTINCT ticker) AS tickers, min(date) AS first, max(date) AS last, round(count(ret) * 100.0 / count(*), 6) AS coverage_ret, round(count(close) * 100.0 / count(*), 6) AS coverage_close FROM p")
def _(s, d):
    return data.quality_report(panel.returns(s, d), ["ret", "close"]).select("n", "tickers", "first", "last", *_r("coverage_ret", "coverage_close"))


@query("src19_sectors", f"WITH {sql.SECTORS} SELECT * FROM s")
def _(s, d):
    return panel.sectors(s, d)


@query("src20_exchange_code", "SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.SH' AS code FROM supplier")
def _(s, d):
    return panel.read(s, d, "supplier").select("s_suppkey", data.exchange_code(F.concat(F.lit("sh."), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"))).alias("code"))


@query("panel_open", f"""SELECT date, ticker, round(u, 10) AS open FROM (SELECT CAST(l_shipdate AS DATE) AS date, concat('S', CAST(l_suppkey AS VARCHAR)) AS ticker, l_extendedprice / l_quantity AS u,
 row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE), l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1""")
def _(s, d):
    return panel.prices(s, d).select("date", "ticker", *_r("open", digits=10))


@query("cal1_sessions", f"{B} SELECT DISTINCT date FROM b WHERE date BETWEEN '1996-01-01' AND '1997-12-31'")
def _(s, d):
    return data.sessions(panel.bars(s, d)).filter("date between '1996-01-01' and '1997-12-31'")


@query("cal3_next_session", f"{B}, c AS (SELECT DISTINCT date FROM b), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) SELECT o.date, (SELECT min(c.date) FROM c WHERE c.date > o.date) AS next FROM o")
def _(s, d):
    days = panel.read(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return data.next_session(days, data.sessions(panel.bars(s, d)))


@query("cal5_align_outer", f"{B} SELECT d.date, t.ticker, round(b.close, 10) AS close FROM (SELECT DISTINCT date FROM b) d CROSS JOIN (SELECT DISTINCT ticker FROM b) t LEFT JOIN b ON b.date = d.date AND b.ticker = t.ticker")
def _(s, d):
    return data.align_outer(panel.bars(s, d)).select("date", "ticker", *_r("close", digits=10))


@query("pit1_fundamentals", f"WITH {sql.FUNDS} SELECT ticker, report_date, publish_date, round(net_income, 6) AS net_income, round(total_assets, 6) AS total_assets, shares FROM f")
def _(s, d):
    return panel.fundamentals(s, d).select("ticker", "report_date", "publish_date", *_r("net_income", "total_assets"), "shares")


_UNI = f"""{B}, c AS (SELECT *, date_diff('day', min(date) OVER (PARTITION BY ticker), date) AS days_since_ipo, {sql.roll("avg(?)", "(close * volume)", 30, 15)} AS adv,
 close * sum(volume) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS market_cap FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY date, adv >= 100 ORDER BY market_cap DESC, ticker) AS k FROM c)
SELECT date, ticker, CAST(days_since_ipo AS INTEGER) AS days_since_ipo, round(adv, 6) AS adv, coalesce(adv >= 100, false) AND k <= 5 AS in_index, days_since_ipo >= 60 AND close >= 1 AND market_cap >= 50000 AS pass_all_filters FROM r"""


@query("uni1_universe", _UNI)
def _(s, d):
    b = panel.bars(s, d)
    cap = b.select("date", "ticker", (F.col("close") * F.sum("volume").over(W.to_date())).alias("market_cap"))
    return data.universe(b, cap, top=5).select("date", "ticker", "days_since_ipo", *_r("adv"), "in_index", "pass_all_filters")


_CN1 = f"""{B}, a AS (SELECT *, volume < 20 AS is_suspended FROM b), c AS (SELECT *, CASE WHEN is_suspended <> lag(is_suspended) OVER {W_T} THEN 1 ELSE 0 END AS ch FROM a),
i AS (SELECT *, sum(ch) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM c),
k AS (SELECT *, sum(CAST(is_suspended AS INT)) OVER (PARTITION BY ticker, g ORDER BY date ROWS UNBOUNDED PRECEDING) AS streak FROM i)
SELECT date, ticker, is_suspended, CAST(streak AS BIGINT) AS streak, streak > 5 AS long_suspension FROM k"""


@query("cn1_suspension_streaks", _CN1)
def _(s, d):
    return data.suspensions(panel.bars(s, d), 20).select("date", "ticker", "is_suspended", "streak", "long_suspension")


@query("cn3_price_limits", f"{P} SELECT date, ticker, ret >= CASE WHEN substr(ticker, 2, 1) = '3' THEN 0.195 ELSE 0.095 END AS up FROM p WHERE ret IS NOT NULL")
def _(s, d):
    p = panel.returns(s, d).filter("ret is not null").withColumn("code", F.when(F.substring("ticker", 2, 1) == "3", "300").otherwise("600"))
    return data.price_limits(p, "code").select("date", "ticker", F.col("limit_up").alias("up"))


@query("cn6_panel_check", f"{P} SELECT ticker, count(*) AS n, round(avg(CASE WHEN ret IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_ret, round(avg(CASE WHEN volume = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_volume, CAST(sum(CASE WHEN abs(ret) > 0.22 THEN 1 ELSE 0 END) AS BIGINT) AS jumps FROM p GROUP BY ticker")
def _(s, d):
    return data.panel_check(panel.returns(s, d)).select("ticker", "n", *_r("null_ret", "zero_volume"), F.coalesce("jumps", F.lit(0)).alias("jumps"))


# --- joins, sets, aggregates, windows ---------------------------------------------------------------------------------


@query("j9_missing_tickers", "SELECT concat('C', CAST(c_custkey AS VARCHAR)) AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(s, d):
    c, o = panel.read(s, d, "customer"), panel.read(s, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("name"))


@query("j8_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(s, d):
    c, o = panel.read(s, d, "customer"), panel.read(s, d, "orders").filter("o_totalprice > 300000")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


@query("j7_sector_map", f"{B}, {sql.SECTORS} SELECT date, sector, count(*) AS n, round(sum(amount), 2) AS amount FROM b JOIN s ON b.ticker = s.ticker GROUP BY 1, 2")
def _(s, d):
    b = panel.bars(s, d).join(F.broadcast(panel.sectors(s, d)), "ticker", "left")
    return b.groupBy("date", "sector").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


_AGG = f"""{P} SELECT ticker, round(stddev_samp(ret), 6) AS sd, round(stddev_pop(ret), 6) AS sd0, round(quantile_cont(ret, 0.5), 6) AS med, round(quantile_cont(ret, 0.05), 6) AS q05,
 round(skewness(ret), 4) AS skew, round(kurtosis(ret), 4) AS kurt, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) FILTER (ret IS NOT NULL), 6) AS hit, count(DISTINCT year(date)) AS years,
 round({sql.corr("ret", "volume")}, 6) AS corr, round(arg_max(close, date), 10) AS last_close FROM (SELECT * FROM p WHERE ret IS NOT NULL) GROUP BY ticker"""


@query("g_aggregates", _AGG)
def _(s, d):
    p, r = panel.returns(s, d).filter("ret is not null"), F.col("ret")
    n = F.count(r)
    return p.groupBy("ticker").agg(
        F.round(F.stddev_samp(r), 6).alias("sd"), F.round(F.stddev_pop(r), 6).alias("sd0"), F.round(F.percentile(r, F.lit(0.5)), 6).alias("med"), F.round(F.percentile(r, F.lit(0.05)), 6).alias("q05"),
        F.round(W.unbiased_skew(F.skewness(r), n), 4).alias("skew"), F.round(W.unbiased_kurtosis(F.kurtosis(r), n), 4).alias("kurt"), F.round(F.avg((r > 0).cast("double")), 6).alias("hit"),
        F.countDistinct(F.year("date")).alias("years"), F.round(W.corr(r, F.col("volume")), 6).alias("corr"), F.round(F.max_by("close", "date"), 10).alias("last_close"),
    )


@query("g12_regression", f"{P}, m AS (SELECT date, avg(ret) AS mkt FROM p GROUP BY date) SELECT ticker, round(regr_slope(ret, mkt), 6) AS beta, round(regr_intercept(ret, mkt), 6) AS alpha, round(regr_r2(ret, mkt), 6) AS r2 FROM p JOIN m ON p.date = m.date GROUP BY ticker")
def _(s, d):
    p = panel.returns(s, d)
    j = p.join(panel.market(p), "date")
    return j.groupBy("ticker").agg(F.round(F.regr_slope("ret", "mkt"), 6).alias("beta"), F.round(F.regr_intercept("ret", "mkt"), 6).alias("alpha"), F.round(F.regr_r2("ret", "mkt"), 6).alias("r2"))


@query("g17_pivot_months", f"{B} SELECT ticker, " + ", ".join(f"count(*) FILTER (month(date) = {m}) AS m{m}" for m in (1, 6, 12)) + " FROM b GROUP BY ticker")
def _(s, d):
    p = panel.bars(s, d).withColumn("m", F.month("date")).groupBy("ticker").pivot("m", [1, 6, 12]).count()
    return p.select("ticker", *[F.coalesce(str(m), F.lit(0)).alias(f"m{m}") for m in (1, 6, 12)])


_WIN = f"""{P} SELECT date, ticker, round(lead(close, 5) OVER {W_T} / close - 1, 6) AS fwd5, round({sql.roll("quantile_cont(?, 0.05)", "ret", 60, 40)}, 6) AS q05, round({sql.roll("quantile_cont(?, 0.5)", "volume", 60, 20)}, 6) AS med,
 round(max(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS peak, round(last_value(CASE WHEN volume > 60 THEN close END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS filled FROM p"""


@query("w_ticker_windows", _WIN)
def _(s, d):
    p, c = panel.returns(s, d), F.col("close")
    return p.select(
        "date", "ticker", F.round(W.lead(c, 5) / c - 1, 6).alias("fwd5"), F.round(W.roll(lambda x: F.percentile(x, F.lit(0.05)), F.col("ret"), 60, 40), 6).alias("q05"), F.round(W.roll(W.median, F.col("volume"), 60, 20), 6).alias("med"),
        F.round(F.max(c).over(W.to_date()), 6).alias("peak"), F.round(W.forward_fill(F.when(F.col("volume") > 60, c)), 6).alias("filled"),
    )


@query("k2_top_names", f"{B} SELECT date, ticker, CAST(k AS INTEGER) AS k FROM (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY amount DESC, ticker) AS k FROM b) WHERE k <= 3")
def _(s, d):
    k = F.row_number().over(Window.partitionBy("date").orderBy(F.col("amount").desc(), "ticker"))
    return panel.bars(s, d).select("date", "ticker", k.alias("k")).filter("k <= 3")


@query("s5_membership_changes", f"""{B}, t AS (SELECT date, ticker FROM (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY amount DESC, ticker) AS k FROM b) WHERE k <= 5),
o AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM t)), q AS (SELECT o.nxt AS date, ticker FROM t JOIN o ON t.date = o.date WHERE o.nxt IS NOT NULL)
SELECT coalesce(t.date, q.date) AS date, count(*) FILTER (t.ticker IS NULL OR q.ticker IS NULL) AS changed FROM t FULL JOIN q ON t.date = q.date AND t.ticker = q.ticker GROUP BY 1""")
def _(s, d):
    k = F.row_number().over(Window.partitionBy("date").orderBy(F.col("amount").desc(), "ticker"))
    t = panel.bars(s, d).select("date", "ticker", k.alias("k")).filter("k <= 5").select("date", "ticker")
    o = t.select("date").distinct().select("date", F.lead("date").over(Window.orderBy("date")).alias("nxt")).filter("nxt is not null")
    q = t.join(F.broadcast(o), "date").select(F.col("nxt").alias("date"), "ticker", F.lit(1).alias("_q"))
    j = t.withColumn("_t", F.lit(1)).join(q, ["date", "ticker"], "full_outer")
    return j.groupBy("date").agg(F.count(F.when(F.col("_t").isNull() | F.col("_q").isNull(), 1)).alias("changed"))


# --- transforms -------------------------------------------------------------------------------------------------------


def signal(s: SparkSession, d: str, name: str = "STR_1W") -> DataFrame:
    return factors.compute(panel.returns(s, d), [name]).withColumnRenamed(name, "x")


SIG = f"""{P}, x AS (SELECT date, ticker, lag(raw, 1) OVER {W_T} AS x FROM (SELECT date, ticker, close / nullif(lag(close, 5) OVER {W_T}, 0) - 1 AS raw FROM p))"""
WINS = SIG + """, q AS (SELECT date, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM x GROUP BY date),
v AS (SELECT x.date, ticker, least(greatest(x, lo), hi) AS x FROM x JOIN q ON x.date = q.date WHERE x IS NOT NULL)"""
_Z = "CASE WHEN x IS NOT NULL THEN coalesce((x - avg(x) OVER (PARTITION BY date)) / nullif(stddev_samp(x) OVER (PARTITION BY date), 0), 0) END"


@query("xf1_lag", f"{P} SELECT date, ticker, round(lag(ret, 3) OVER {W_T}, 6) AS x FROM p")
def _(s, d):
    return X.apply_lag(panel.returns(s, d), "ret", 3).select("date", "ticker", F.round("ret", 6).alias("x"))


@query("xf2_missing_median", SIG + " SELECT x.date, ticker, round(coalesce(x, m), 6) AS x FROM x JOIN (SELECT date, quantile_cont(x, 0.5) AS m FROM x GROUP BY date) q ON x.date = q.date")
def _(s, d):
    return X.handle_missing(signal(s, d), "x", "median").select("date", "ticker", *_r("x"))


@query("xf3_winsorize", WINS + " SELECT date, ticker, round(x, 6) AS x FROM v")
def _(s, d):
    return X.winsorize(X.handle_missing(signal(s, d), "x"), "x").select("date", "ticker", *_r("x"))


@query("xf4_zscore", SIG + f" SELECT date, ticker, round({_Z}, 6) AS x FROM x")
def _(s, d):
    return X.zscore(signal(s, d), "x").select("date", "ticker", *_r("x"))


@query("xf5_rank", SIG + f" SELECT date, ticker, round({sql.rank('x', 'date')} / count(*) OVER (PARTITION BY date), 6) AS x FROM x WHERE x IS NOT NULL")
def _(s, d):
    return X.rank(signal(s, d), "x").filter("x is not null").select("date", "ticker", *_r("x"))


@query("xf6_neutralize_sector", SIG + f", {sql.SECTORS} SELECT date, x.ticker, round(x - avg(x) OVER (PARTITION BY date, sector), 6) AS x FROM x JOIN s ON x.ticker = s.ticker")
def _(s, d):
    return X.neutralize_group(signal(s, d).join(F.broadcast(panel.sectors(s, d)), "ticker"), "x", "sector").select("date", "ticker", *_r("x"))


@query("xf7_neutralize_size", SIG + f""", j AS (SELECT x.date, x.ticker, x, CASE WHEN x IS NOT NULL THEN ln(amount) END AS z FROM x JOIN p ON x.date = p.date AND x.ticker = p.ticker),
g AS (SELECT date, count(x) AS n, avg(x) AS mx, avg(z) AS mz, covar_samp(x, z) / nullif(var_samp(z), 0) AS b FROM j GROUP BY date)
SELECT j.date, ticker, round(CASE WHEN n < 3 THEN x WHEN x IS NOT NULL THEN x - mx - coalesce(b, 0) * (z - mz) END, 6) AS x FROM j JOIN g ON j.date = g.date""")
def _(s, d):
    sig = signal(s, d).join(panel.bars(s, d).select("date", "ticker", F.log("amount").alias("z")), ["date", "ticker"])
    return X.neutralize_linear(sig, "x", "z").select("date", "ticker", *_r("x"))


@query("xf10_effective_signal", WINS + f", n AS (SELECT date, ticker, -x AS x FROM v), z AS (SELECT date, ticker, {_Z} AS x FROM n) SELECT date, ticker, round({sql.rank('x', 'date')} / count(*) OVER (PARTITION BY date), 6) AS x FROM z")
def _(s, d):
    return X.effective_signal(signal(s, d), "x", -1).select("date", "ticker", *_r("x"))


_EFF = f"""{P}, r AS (SELECT date, ticker, 'STR_1W' AS factor, -lag(raw, 1) OVER {W_T} AS x FROM (SELECT date, ticker, close / nullif(lag(close, 5) OVER {W_T}, 0) - 1 AS raw FROM p)
 UNION ALL SELECT date, ticker, 'MOM_1M', lag(raw, 1) OVER {W_T} FROM (SELECT date, ticker, close / nullif(lag(close, 21) OVER {W_T}, 0) - 1 AS raw FROM p)),
q AS (SELECT date, factor, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM r GROUP BY date, factor), v AS (SELECT r.date, r.ticker, r.factor, least(greatest(x, lo), hi) AS x FROM r JOIN q ON r.date = q.date AND r.factor = q.factor WHERE x IS NOT NULL),
e AS (SELECT date, ticker, factor, {sql.rank('x', 'date, factor')} / count(*) OVER (PARTITION BY date, factor) AS value FROM v)"""


def effective(s: SparkSession, d: str) -> DataFrame:
    return X.effective_frame(factors.compute(panel.returns(s, d), ["STR_1W", "MOM_1M"]), {"STR_1W": -1, "MOM_1M": 1})


@query("xf11_effective_frame", _EFF + " SELECT date, ticker, factor, round(value, 6) AS value FROM e")
def _(s, d):
    return effective(s, d).select("date", "ticker", "factor", *_r("value"))


# --- evaluation -------------------------------------------------------------------------------------------------------

FWD = SIG + f""", w AS (SELECT date, ticker, lead(close, 1) OVER {W_T} / nullif(close, 0) - 1 AS f1, lead(close, 5) OVER {W_T} / nullif(close, 0) - 1 AS f5, amount FROM p),
j AS (SELECT x.date, x.ticker, x, f1, f5, amount FROM x JOIN w ON x.date = w.date AND x.ticker = w.ticker), u AS (SELECT * FROM j WHERE x IS NOT NULL AND f1 IS NOT NULL)"""
RIC = FWD + f""", k AS (SELECT date, {sql.rank('x', 'date')} AS rx, {sql.rank('f1', 'date')} AS ry FROM u), ic AS (SELECT date, count(*) AS n, CASE WHEN count(*) >= 5 THEN {sql.corr('rx', 'ry')} END AS ic FROM k GROUP BY date)"""
BINS = FWD + """, ed AS (SELECT date, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS e FROM u GROUP BY date),
bn AS (SELECT u.date, ticker, f1, amount, CAST(len(list_filter(list_distinct(e), lambda v: v < x)) + 1 AS INTEGER) AS bin FROM u JOIN ed ON u.date = ed.date), qr AS (SELECT date, bin, avg(f1) AS ret, count(*) AS n FROM bn GROUP BY date, bin)"""


def evaluated(s: SparkSession, d: str) -> DataFrame:
    p = panel.returns(s, d)
    return E.forward_returns(p, (1, 5)).join(signal(s, d), ["date", "ticker"])


def rank_ic(s: SparkSession, d: str) -> DataFrame:
    return E.ic_series(evaluated(s, d), "x", "fwd_1")


@query("ev2_ic", FWD + f" SELECT date, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN {sql.corr('x', 'f1')} END, 6) AS ic FROM u GROUP BY date")
def _(s, d):
    return E.ic_series(evaluated(s, d), "x", "fwd_1", ranked=False).select("date", "n", *_r("ic"))


@query("ev3_rank_ic", RIC + " SELECT date, n, round(ic, 6) AS ic FROM ic")
def _(s, d):
    return rank_ic(s, d).select("date", "n", *_r("ic"))


@query("ev4_ic_summary", RIC + " SELECT round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS std_ic, round(avg(ic) / stddev_samp(ic) * sqrt(252), 5) AS icir, round(avg(ic) / stddev_samp(ic) * sqrt(count(ic)), 5) AS t_stat, round(avg(CASE WHEN ic > 1e-12 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END), 6) AS hit_rate, round(skewness(ic), 4) AS skew, round(kurtosis(ic), 4) AS kurt, count(ic) AS n FROM ic")
def _(s, d):
    return E.ic_summary(rank_ic(s, d)).select(*_r("mean_ic", "std_ic"), *_r("icir", "t_stat", digits=5), *_r("hit_rate"), *_r("skew", "kurt", digits=4), "n")


@query("ev5_ic_decay", RIC + f""", k5 AS (SELECT date, {sql.rank('x', 'date')} AS rx, {sql.rank('f5', 'date')} AS ry FROM j WHERE x IS NOT NULL AND f5 IS NOT NULL), ic5 AS (SELECT date, CASE WHEN count(*) >= 5 THEN {sql.corr('rx', 'ry')} END AS ic FROM k5 GROUP BY date),
a AS (SELECT 1 AS h, ic FROM ic UNION ALL SELECT 5, ic FROM ic5) SELECT h, round(avg(ic), 6) AS mean_ic, round(avg(ic) / stddev_samp(ic) * sqrt(252), 5) AS icir, count(ic) AS n FROM a GROUP BY h""")
def _(s, d):
    p = panel.returns(s, d).join(signal(s, d), ["date", "ticker"])
    return E.ic_decay(p, "x", (1, 5)).select("h", *_r("mean_ic"), *_r("icir", digits=5), "n")


@query("ev6_quantile_returns", BINS + " SELECT date, bin, round(ret, 6) AS ret, n FROM qr")
def _(s, d):
    return E.quantile_returns(evaluated(s, d), "x", "fwd_1").select("date", "bin", *_r("ret"), "n")


@query("ev7_long_short", BINS + " SELECT date, round(max(CASE WHEN bin = 5 THEN ret END) - max(CASE WHEN bin = 1 THEN ret END), 6) AS ls FROM qr GROUP BY date")
def _(s, d):
    return E.long_short(E.quantile_returns(evaluated(s, d), "x", "fwd_1")).select("date", *_r("ls"))


@query("ev8_turnover", SIG + f""", y AS (SELECT * FROM x WHERE x IS NOT NULL), o AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM y)),
t AS (SELECT y.date, y.x AS a, z.x AS b FROM y JOIN o ON y.date = o.date JOIN y z ON z.date = o.prev AND z.ticker = y.ticker), k AS (SELECT date, {sql.rank('a', 'date')} AS a, {sql.rank('b', 'date')} AS b FROM t)
SELECT date, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN 1 - {sql.corr('a', 'b')} END, 6) AS turnover FROM k GROUP BY date""")
def _(s, d):
    return E.turnover(signal(s, d), "x").select("date", "n", *_r("turnover"))


@query("ev10_monotonicity", BINS + f", m AS (SELECT bin, avg(ret) AS r FROM qr GROUP BY bin), k AS (SELECT rank() OVER (ORDER BY bin) AS a, rank() OVER (ORDER BY r) AS b FROM m) SELECT count(*) AS n, round({sql.corr('a', 'b')}, 6) AS monotonicity FROM k")
def _(s, d):
    return E.monotonicity(E.quantile_returns(evaluated(s, d), "x", "fwd_1")).select("n", *_r("monotonicity"))


@query("ev11_capacity", FWD + ", c AS (SELECT date, x, amount, quantile_cont(x, 0.8) OVER (PARTITION BY date) AS q FROM j WHERE x IS NOT NULL) SELECT date, round(0.1 * sum(amount), 4) AS capacity, count(*) AS n FROM c WHERE x >= q GROUP BY date")
def _(s, d):
    return E.capacity(evaluated(s, d), "x", "amount").select("date", *_r("capacity", digits=4), "n")


@query("ev12_market_split", RIC + ", m AS (SELECT date, avg(ret) AS mkt FROM p GROUP BY date), md AS (SELECT quantile_cont(mkt, 0.5) AS q FROM m) SELECT mkt >= q AS up, round(avg(ic), 6) AS mean_ic, count(ic) AS n FROM ic JOIN m ON ic.date = m.date, md GROUP BY 1")
def _(s, d):
    return E.market_split(rank_ic(s, d), panel.market(panel.returns(s, d))).select("up", *_r("mean_ic"), "n")


@query("ev13_stability", RIC + " SELECT CAST(chunk AS INTEGER) AS chunk, round(avg(ic), 6) AS mean_ic, round(avg(CASE WHEN ic > 1e-12 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END), 6) AS hit_rate, count(*) AS n FROM (SELECT *, ntile(3) OVER (ORDER BY date) AS chunk FROM ic) GROUP BY chunk")
def _(s, d):
    return E.stability(rank_ic(s, d)).select("chunk", *_r("mean_ic", "hit_rate"), "n")
