"""Queries of the factor library, lagged by each factor's own lag, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import factors, kernels, value_quality
from ..sources import panel
from . import sql
from .sql import roll, w

Y = "sqrt(252)"
_P = f"WITH {sql.PANEL}"
_RET2 = f"{_P}, q AS (SELECT p.*, m.mkt FROM p JOIN (SELECT date, avg(ret) AS mkt FROM p GROUP BY date) m ON p.date = m.date)"
_NEG = "(CASE WHEN ret < 0 THEN ret * ret END)"
_R0 = f"{_P}, q AS (SELECT *, coalesce(ret, 0) AS r0 FROM p)"
_ABS = "(CASE WHEN ret IS NOT NULL THEN volume * sign(ret) END)"
_IDIO = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"


def _pop(agg: str, k: int) -> str:
    return f"{_R0} " + sql.lagged(f"CASE WHEN count(*) OVER {w(60)} = 60 AND var_pop(r0) OVER {w(60)} >= 1e-30 THEN {agg} END", k, "q", 4)


def _moments(x: str) -> str:
    """Population skewness from the corrected one."""
    return f"(skewness({x}) OVER {w(60)}) * (60 - 2) / sqrt(60.0 * 59.0)"


_OU = f"""{_P}, a AS (SELECT date, ticker, ln(close) AS y, ln(lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS x FROM p),
s AS (SELECT date, ticker, y, count(x) OVER v AS m, sum(x) OVER v AS sx, sum(CASE WHEN x IS NOT NULL THEN y END) OVER v AS sy, sum(x * x) OVER v AS sxx, sum(x * y) OVER v AS sxy,
 sum(CASE WHEN x IS NOT NULL THEN y * y END) OVER v AS syy FROM a WINDOW v AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 58 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, (m * sxy - sx * sy) / nullif(m * sxx - sx * sx, 0) AS a, (sy * sxx - sx * sxy) / nullif(m * sxx - sx * sx, 0) AS b FROM s),
o AS (SELECT *, -ln(CASE WHEN a > 0 AND a < 1 THEN a END) * 252 AS theta, b / (1 - CASE WHEN a > 0 AND a < 1 THEN a END) AS mu,
 syy - 2 * a * sxy - 2 * b * sy + a * a * sxx + 2 * a * b * sx + m * b * b AS sse FROM c),
q AS (SELECT date, ticker, CASE WHEN m = 59 THEN coalesce((y - mu) / (sqrt((CASE WHEN sse > 0 THEN sse END) / m * 2 * theta / (1 - a * a)) / sqrt(2 * theta)), 0) END AS raw FROM o)
SELECT date, ticker, round(lag(raw, 1) OVER (PARTITION BY ticker ORDER BY date), 4) AS value FROM q"""

_SPREAD = f"""{_P}, a AS (SELECT *, ln(high / low) ^ 2 AS bt, CASE WHEN count(*) OVER {w(2)} = 2 THEN ln(max(high) OVER {w(2)} / min(low) OVER {w(2)}) ^ 2 END AS g FROM p),
c AS (SELECT *, bt + lag(bt) OVER (PARTITION BY ticker ORDER BY date) AS bs FROM a),
e AS (SELECT *, (sqrt(2 * bs) - sqrt(bs)) / (2 * sqrt(2) - 1) - sqrt(g / (2 * sqrt(2) - 1)) AS al FROM c),
h AS (SELECT date, ticker, CASE WHEN al IS NOT NULL THEN greatest(2 * (exp(al) - 1) / (1 + exp(al)), 0) END AS s FROM e) """

ORACLES: dict[str, str] = {}
for _n, _k, _lag in (("MOM_1M", 21, 1), ("MOM_3M", 63, 1), ("MOM_6M", 126, 1), ("MOM_12_1M", 252, 21), ("STR_1W", 5, 1), ("STR_1M", 21, 1)):
    ORACLES[_n] = f"{_P} " + sql.lagged(f"close / nullif(lag(close, {_k}) OVER (PARTITION BY ticker ORDER BY date), 0) - 1", _lag, "p")
ORACLES |= {
    "MOM_PATH": f"{_P}, q AS (SELECT *, close / ({roll('max(?)', 'close', 126, 126)}) - 1 AS dd FROM p) " + sql.lagged(f"(close / nullif(lag(close, 126) OVER (PARTITION BY ticker ORDER BY date), 0) - 1) / nullif(abs({roll('min(?)', 'dd', 126, 126)}), 0)", 1, "q"),
    "VOL_20D": f"{_P} " + sql.lagged(f"({roll('stddev_samp(?)', 'ret', 20, 15)}) * {Y}", 1, "p"),
    "VOL_60D": f"{_P} " + sql.lagged(f"({roll('stddev_samp(?)', 'ret', 60, 40)}) * {Y}", 1, "p"),
    "IDIOVOL": f"{_RET2} " + sql.lagged(f"CASE WHEN count(ret) OVER {_IDIO} >= 10 THEN sqrt(greatest((regr_syy(ret, mkt) OVER {_IDIO}) * (1 - regr_r2(ret, mkt) OVER {_IDIO}), 0) / (count(ret) OVER {_IDIO} - 1)) * {Y} END", 1, "q", 4),
    "SKEW_60D": f"{_P} " + sql.lagged(roll("skewness(?)", "ret", 60, 40), 1, "p", 4),
    "KURT_60D": f"{_P} " + sql.lagged(roll("kurtosis(?)", "ret", 60, 40), 1, "p", 4),
    "DOWNVOL_60D": f"{_P} " + sql.lagged(f"CASE WHEN count({_NEG}) OVER {w(60)} >= 40 THEN sqrt(avg({_NEG}) OVER {w(60)}) * {Y} WHEN count(ret) OVER {w(60)} >= 40 THEN 0.0 END", 1, "p"),
    "TAIL_RISK": f"{_P}, q AS (SELECT date, ticker, count(ret) OVER {w(60)} AS n, count(*) OVER {w(60)} AS k, quantile_cont(ret, 0.05) OVER {w(60)} AS q5, list(ret) OVER {w(60)} AS l FROM p) " + sql.lagged("CASE WHEN n >= 40 AND k = 60 THEN list_avg(list_filter(l, lambda x: x <= q5)) END", 1, "q"),
    "VOL_OF_VOL": f"{_P}, q AS (SELECT *, ({roll('stddev_samp(?)', 'ret', 20, 15)}) * {Y} AS v FROM p) " + sql.lagged(roll("stddev_samp(?)", "v", 60, 40), 1, "q"),
    "REALIZED_JUMP": f"{_P}, q AS (SELECT *, abs(ret * lag(ret) OVER (PARTITION BY ticker ORDER BY date)) AS bp, ret * ret AS r2 FROM p), u AS (SELECT date, ticker, 1 - pi() / 2 * ({roll('sum(?)', 'bp', 60, 40)}) / nullif({roll('sum(?)', 'r2', 60, 40)}, 0) AS j FROM q) " + sql.lagged("CASE WHEN j IS NOT NULL THEN greatest(j, 0) END", 1, "u"),
    "ILLIQ_AMIHUD": f"{_P}, q AS (SELECT *, abs(ret) / nullif(abs(close) * volume, 0) * 1e6 AS i FROM p) " + sql.lagged(roll("avg(?)", "i", 60, 40), 1, "q"),
    "VOLUME_CV": f"{_P} " + sql.lagged(f"({roll('stddev_samp(?)', 'volume', 60, 40)}) / nullif({roll('avg(?)', 'volume', 60, 40)}, 0)", 1, "p"),
    "PRICE_IMPACT": f"{_P}, q AS (SELECT *, abs(ret) AS ar, {_ABS} AS sv FROM p) " + sql.lagged(f"CASE WHEN count(ret) OVER {w(60)} >= 40 THEN (covar_samp(sv, ar) OVER {w(60)}) / nullif(var_samp(sv) OVER {w(60)}, 0) END", 1, "q"),
    "TURNOVER_ACCEL": f"{_P} " + sql.lagged(f"({roll('avg(?)', 'volume', 20, 15)}) / nullif({roll('avg(?)', 'volume', 60, 40)}, 0) - 1", 1, "p"),
    "ABNORMAL_VOLUME": f"{_P} " + sql.lagged(f"(volume - ({roll('avg(?)', 'volume', 60, 40)})) / nullif({roll('stddev_samp(?)', 'volume', 60, 40)}, 0)", 1, "p"),
    "SPREAD_HL": _SPREAD + sql.lagged(roll("avg(?)", "s", 20, 15), 1, "h"),
    "ROLLING_SKEW_60D": _pop(_moments("r0"), 1),
    "ROLLING_KURT_60D": _pop(f"kurtosis_pop(r0) OVER {w(60)}", 1),
    "OU_ZSCORE": _OU,
}
for _n, _a, _b, _m, _k in (("TURNOVER_20D", 20, 15, 60, 20), ("TURNOVER_60D", 60, 40, 120, 40)):
    ORACLES[_n] = f"{_P}, q AS (SELECT *, volume / nullif({roll('quantile_cont(?, 0.5)', 'volume', _m, _k)}, 0) AS t FROM p) " + sql.lagged(roll("avg(?)", "t", _a, _b), 1, "q")

#: Digits that survive another order of summation.
DIGITS = dict.fromkeys(("IDIOVOL", "SKEW_60D", "KURT_60D", "ROLLING_SKEW_60D", "ROLLING_KURT_60D", "OU_ZSCORE"), 4)
_ORDER = (
    "MOM_1M MOM_3M MOM_6M MOM_12_1M STR_1W STR_1M MOM_PATH VOL_20D VOL_60D IDIOVOL SKEW_60D KURT_60D DOWNVOL_60D TAIL_RISK VOL_OF_VOL REALIZED_JUMP "
    "TURNOVER_20D TURNOVER_60D ILLIQ_AMIHUD VOLUME_CV PRICE_IMPACT TURNOVER_ACCEL ABNORMAL_VOLUME SPREAD_HL EARNINGS_YIELD BOOK_TO_MARKET GROSS_PROFITABILITY "
    "ASSET_GROWTH KF_VELOCITY KF_TREND_STRENGTH KF_NOISE_RATIO SPECTRAL_ENTROPY_60D HURST_60D ROLLING_SKEW_60D ROLLING_KURT_60D ACF_DECAY_60D HMM_TURBULENCE_PROB OU_ZSCORE"
).split()
NUMBER = {n: i + 1 for i, n in enumerate(_ORDER)}


def key(name: str) -> str:
    return f"f{NUMBER[name]:02d}_{name.lower()}"


def _window_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = factors.compute(panel.returns(spark, sf_dir), [name])
        return d.select("date", "ticker", F.round(name, DIGITS.get(name, 6)).alias("value"))

    return run


def _kernel_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = kernels.compute(panel.bars(spark, sf_dir), [name])
        return d.select("date", "ticker", F.round(name, 6).alias("value"))

    return run


def _value_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = value_quality.compute(panel.bars(spark, sf_dir), panel.fundamentals(spark, sf_dir), name)
        return d.select("date", "ticker", F.round("value", 6).alias("value"))

    return run


_PIT = f"""WITH {sql.BARS}, {sql.FUNDS}, t AS (SELECT *, CASE WHEN count(*) OVER v >= 4 THEN sum(net_income) OVER v ELSE net_income END AS ttm_ni,
 CASE WHEN count(*) OVER v >= 4 THEN sum(gross_profit) OVER v ELSE gross_profit END AS ttm_gp FROM f WINDOW v AS (PARTITION BY ticker ORDER BY report_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
x AS (SELECT b.date, b.ticker, b.close, t.* EXCLUDE (ticker) FROM b ASOF LEFT JOIN t ON b.ticker = t.ticker AND b.date > t.publish_date) """
_GROWTH = f"""WITH {sql.BARS}, {sql.FUNDS}, y AS (SELECT a.ticker, a.publish_date, a.report_date, a.total_assets, arg_min(c.total_assets, (abs(date_diff('day', c.report_date, CAST(a.report_date - INTERVAL 365 DAY AS DATE))), c.report_date)) AS prior
 FROM f a LEFT JOIN f c ON a.ticker = c.ticker AND c.report_date < a.report_date AND abs(date_diff('day', c.report_date, CAST(a.report_date - INTERVAL 365 DAY AS DATE))) <= 120 GROUP BY ALL),
x AS (SELECT b.date, b.ticker, y.total_assets / nullif(y.prior, 0) - 1 AS raw FROM b ASOF LEFT JOIN y ON b.ticker = y.ticker AND b.date > y.publish_date) """
ORACLES |= {
    "EARNINGS_YIELD": _PIT + sql.lagged("ttm_ni / nullif(shares * close, 0)", 1, "x"),
    "BOOK_TO_MARKET": _PIT + sql.lagged("total_equity / nullif(shares * close, 0)", 1, "x"),
    "GROSS_PROFITABILITY": _PIT + sql.lagged("ttm_gp / nullif(total_assets, 0)", 1, "x"),
    "ASSET_GROWTH": _GROWTH + sql.lagged("raw", 1, "x"),
}

QUERIES = {key(n): _window_query(n) for n in factors.FACTORS} | {key(n): _kernel_query(n) for n in kernels.KERNELS} | {key(n): _value_query(n) for n in value_quality.FACTORS}
ORACLE_SQL = {key(n): s for n, s in ORACLES.items()}
