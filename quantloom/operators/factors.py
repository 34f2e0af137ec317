"""The factor library: metadata, and a Column over the panel for every factor that a window can express.

Factors are keyed by name.  ``compute`` adds any number of them to a panel in
one pass: every ticker window shares one exchange and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W

YEAR = math.sqrt(252.0)


@dataclass(frozen=True)
class FactorMeta:
    name: str
    category: str
    lookback: int
    lag: int = 1
    direction: int = 1
    signal_type: str = "cross_sectional"

    def with_(self, **changes) -> FactorMeta:
        return replace(self, **changes)


@dataclass(frozen=True)
class Factor:
    """``build(frame)`` returns (intermediate columns, stage by stage) and the raw factor Column."""

    meta: FactorMeta
    stages: Callable[[], list[dict[str, Column]]]
    value: Callable[[], Column]


FACTORS: dict[str, Factor] = {}


def register(name, category, lookback, lag, direction, value, stages=lambda: [], signal_type="cross_sectional"):
    FACTORS[name] = Factor(FactorMeta(name, category, lookback, lag, direction, signal_type), stages, value)


def c(name: str) -> Column:
    return F.col(name)


for _name, _k, _lag, _dir in (("MOM_1M", 21, 1, 1), ("MOM_3M", 63, 1, 1), ("MOM_6M", 126, 1, 1), ("MOM_12_1M", 252, 21, 1), ("STR_1W", 5, 1, -1), ("STR_1M", 21, 1, -1)):
    register(_name, "momentum", _k + 1, _lag, _dir, lambda k=_k: W.pct_change(c("close"), k))
register(
    "MOM_PATH", "momentum", 127, 1, 1,
    lambda: W.div(W.pct_change(c("close"), 126), F.nullif(F.abs(W.roll(F.min, c("_dd"), 126, 126)), F.lit(0.0))),
    lambda: [{"_dd": W.div(c("close"), W.roll(F.max, c("close"), 126, 126)) - 1}],
)
register("VOL_20D", "volatility", 21, 1, -1, lambda: W.roll(F.stddev_samp, c("ret"), 20, 15) * YEAR)
register("VOL_60D", "volatility", 61, 1, -1, lambda: W.roll(F.stddev_samp, c("ret"), 60, 40) * YEAR)


def _idio() -> Column:
    w = W.by_ticker().rowsBetween(-60, -1)
    both = c("ret").isNotNull() & c("mkt").isNotNull()
    y, x = F.when(both, c("ret")), F.when(both, c("mkt"))
    n = F.count(y).over(w)
    sse = F.regr_syy(y, x).over(w) * (1 - F.regr_r2(y, x).over(w))
    return F.when(n >= 10, F.sqrt(F.greatest(sse, F.lit(0.0)) / F.nullif(n - 1, F.lit(0))) * YEAR)


register("IDIOVOL", "volatility", 61, 1, -1, _idio, lambda: [{"mkt": F.avg("ret").over(W.by_date())}])


def _moment(agg, fix, n, least):
    def build() -> Column:
        w = W.last_rows(n)
        k = F.count("ret").over(w)
        return F.when(k >= least, fix(agg(c("ret")).over(w), k))

    return build


register("SKEW_60D", "volatility", 61, 1, 1, _moment(F.skewness, W.unbiased_skew, 60, 40))
register("KURT_60D", "volatility", 61, 1, -1, _moment(F.kurtosis, W.unbiased_kurtosis, 60, 40))


def _down() -> Column:
    w = W.last_rows(60)
    neg = F.when(c("ret") < 0, c("ret") * c("ret"))
    return F.when(F.count(neg).over(w) >= 40, F.sqrt(F.avg(neg).over(w)) * YEAR).when(F.count("ret").over(w) >= 40, F.lit(0.0))


register("DOWNVOL_60D", "volatility", 61, 1, -1, _down)
register(
    "TAIL_RISK", "volatility", 61, 1, -1,
    lambda: F.when((c("_n") >= 40) & (c("_rows") == 60), F.aggregate(F.filter("_all", lambda r: r <= c("_q")), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, r: F.struct((a["s"] + r).alias("s"), (a["n"] + 1).alias("n")), lambda a: W.div(a["s"], a["n"]))),
    lambda: [{"_n": F.count("ret").over(W.last_rows(60)), "_rows": F.count("*").over(W.last_rows(60)), "_q": F.percentile("ret", F.lit(0.05)).over(W.last_rows(60)), "_all": F.collect_list("ret").over(W.last_rows(60))}],
)
register("VOL_OF_VOL", "volatility", 80, 1, -1, lambda: W.roll(F.stddev_samp, c("_v20"), 60, 40), lambda: [{"_v20": W.roll(F.stddev_samp, c("ret"), 20, 15) * YEAR}])
register(
    "REALIZED_JUMP", "volatility", 61, 1, -1,
    lambda: F.when(W.div(W.roll(F.sum, c("_bp"), 60, 40), W.roll(F.sum, c("ret") * c("ret"), 60, 40)).isNotNull(), F.greatest(F.lit(0.0), 1 - math.pi / 2 * W.div(W.roll(F.sum, c("_bp"), 60, 40), W.roll(F.sum, c("ret") * c("ret"), 60, 40)))),
    lambda: [{"_bp": F.abs(c("ret") * W.lag(c("ret")))}],
)
for _name, _n, _least, _m, _mleast in (("TURNOVER_20D", 20, 15, 60, 20), ("TURNOVER_60D", 60, 40, 120, 40)):
    register(_name, "liquidity", _n + 1, 1, -1, lambda n=_n, k=_least: W.roll(F.avg, c("_t"), n, k), lambda m=_m, k=_mleast: [{"_t": W.div(c("volume"), W.roll(W.median, c("volume"), m, k))}])
register("ILLIQ_AMIHUD", "liquidity", 61, 1, -1, lambda: W.roll(F.avg, W.div(F.abs(c("ret")), F.abs(c("close")) * c("volume")) * 1e6, 60, 40))
register("VOLUME_CV", "liquidity", 61, 1, -1, lambda: W.div(W.roll(F.stddev_samp, c("volume"), 60, 40), W.roll(F.avg, c("volume"), 60, 40)))


def _impact() -> Column:
    w = W.last_rows(60)
    y, x = F.abs(c("ret")), c("volume") * F.signum(c("ret"))
    return F.when(F.count("ret").over(w) >= 40, W.div(F.covar_samp(x, y).over(w), F.var_samp(x).over(w)))


register("PRICE_IMPACT", "liquidity", 61, 1, -1, _impact)
register("TURNOVER_ACCEL", "liquidity", 61, 1, -1, lambda: W.div(W.roll(F.avg, c("volume"), 20, 15), W.roll(F.avg, c("volume"), 60, 40)) - 1)
register("ABNORMAL_VOLUME", "liquidity", 61, 1, -1, lambda: W.div(c("volume") - W.roll(F.avg, c("volume"), 60, 40), W.roll(F.stddev_samp, c("volume"), 60, 40)))


def _spread_stages() -> list[dict[str, Column]]:
    two = W.last_rows(2)
    k = 2 * math.sqrt(2) - 1
    beta = F.pow(F.log(W.div(c("high"), c("low"))), F.lit(2.0))
    return [
        {"_b": beta, "_g": F.when(F.count("*").over(two) == 2, F.pow(F.log(W.div(F.max("high").over(two), F.min("low").over(two))), F.lit(2.0)))},
        {"_bs": c("_b") + W.lag(c("_b"))},
        {"_a": (F.sqrt(2 * c("_bs")) - F.sqrt(c("_bs"))) / k - F.sqrt(c("_g") / k)},
        {"_s": F.when(c("_a").isNotNull(), F.greatest(2 * (F.exp("_a") - 1) / (1 + F.exp("_a")), F.lit(0.0)))},
    ]


register("SPREAD_HL", "liquidity", 22, 1, -1, lambda: W.roll(F.avg, c("_s"), 20, 15), _spread_stages)


def _pop(agg):
    def build() -> Column:
        w = W.last_rows(60)
        return F.when((F.count("*").over(w) == 60) & (F.var_pop("_r0").over(w) >= 1e-30), agg(c("_r0")).over(w))

    return build


_R0 = lambda: [{"_r0": F.coalesce("ret", F.lit(0.0))}]
register("ROLLING_SKEW_60D", "moments", 61, 1, 1, _pop(F.skewness), _R0, "time_series")
register("ROLLING_KURT_60D", "moments", 61, 1, -1, _pop(F.kurtosis), _R0, "time_series")


def _ou_stages() -> list[dict[str, Column]]:
    w = W.by_ticker().rowsBetween(-58, 0)
    x, y = c("_x"), c("_y")
    s = lambda v: F.sum(v).over(w)
    dt = 1 / 252
    return [
        {"_y": F.log("close")},
        {"_x": W.lag(c("_y"))},
        {"_m": F.count("_x").over(w), "_sx": s(x), "_sy": s(F.when(x.isNotNull(), y)), "_sxx": s(x * x), "_sxy": s(x * y), "_syy": s(F.when(x.isNotNull(), y * y))},
        {"_den": c("_m") * c("_sxx") - c("_sx") * c("_sx")},
        {"_a": W.div(c("_m") * c("_sxy") - c("_sx") * c("_sy"), c("_den")), "_b": W.div(c("_sy") * c("_sxx") - c("_sx") * c("_sxy"), c("_den"))},
        {"_ok": (c("_m") == 59) & (F.abs("_den") > 1e-12) & (c("_a") > 0) & (c("_a") < 1)},
        {
            "_theta": F.when(c("_ok"), -F.log("_a") / dt), "_mu": F.when(c("_ok"), c("_b") / F.nullif(1 - c("_a"), F.lit(0.0))),
            "_sse": c("_syy") - 2 * c("_a") * c("_sxy") - 2 * c("_b") * c("_sy") + c("_a") * c("_a") * c("_sxx") + 2 * c("_a") * c("_b") * c("_sx") + c("_m") * c("_b") * c("_b"),
        },
        {"_sig": F.when(c("_ok") & (c("_sse") > 0), F.sqrt(c("_sse") / c("_m") * 2 * c("_theta") / F.nullif(1 - c("_a") * c("_a"), F.lit(0.0))))},
    ]


register("OU_ZSCORE", "relative_value", 61, 1, 1, lambda: F.when(c("_m") == 59, F.coalesce(W.div(c("_y") - c("_mu"), W.div(c("_sig"), F.sqrt(2 * c("_theta")))), F.lit(0.0))), _ou_stages, "relative_value")


def compute(panel: DataFrame, names: list[str], lagged: bool = True) -> DataFrame:
    """date, ticker and the named factors; panel has close, high, low, volume and ret.
    """
    d = panel
    for name in names:
        stages = FACTORS[name].stages()
        for stage in stages:
            d = d.withColumns(stage)
        d = d.withColumn(name, FACTORS[name].value()).drop(*[x for stage in stages for x in stage])
    lags = {n: F.lag(n, FACTORS[n].meta.lag).over(W.by_ticker()) if lagged else F.col(n) for n in names}
    return d.select("date", "ticker", *[v.alias(n) for n, v in lags.items()])
