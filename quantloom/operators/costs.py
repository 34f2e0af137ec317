"""Trading costs as column expressions, trades, and daily profit and loss."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from .portfolio import changes


@dataclass(frozen=True)
class CostModel:
    """Rates of a US-style cost model."""

    per_share: float = 0.005
    least_commission: float = 1.0
    commission_pct: float = 0.0
    slippage_bps: float = 5.0
    impact: float = 0.1
    impact_power: float = 0.5
    sec_fee: float = 8e-6
    taf_per_share: float = 1.19e-4
    stamp_buy: float = 0.0
    borrow_rate: float = 0.02

    def columns(self, side: Column, shares: Column, price: Column, adv: Column, vol: Column) -> dict[str, Column]:
        """commission, slippage, impact_cost, fees, stamp, total_cost and total_bps of a trade."""
        n = shares * price
        live = (shares > 0) & (price > 0)
        per = n * self.commission_pct if self.commission_pct else shares * self.per_share
        cost = {
            "commission": F.greatest(per, F.lit(self.least_commission)),
            "slippage": n * (self.slippage_bps / 1e4),
            "impact_cost": self.impact * vol * F.pow(shares / F.greatest(adv, F.lit(1.0)), F.lit(self.impact_power)) * n,
            "fees": F.when(side == "sell", n * self.sec_fee + shares * self.taf_per_share).otherwise(0.0),
            "stamp": F.when(side == "buy", n * self.stamp_buy).otherwise(0.0),
        }
        total = sum(cost.values(), F.lit(0.0))
        zero = F.lit(0.0)
        out = {k: F.when(live, F.round(v, 4)).otherwise(zero) for k, v in cost.items()}
        return out | {"total_cost": F.when(live, F.round(total, 4)).otherwise(zero), "total_bps": F.when(live, F.round(W.div(total, n) * 1e4, 2)).otherwise(zero)}


@dataclass(frozen=True)
class ChinaCostModel:
    """Commission on both sides, stamp duty on sales, transfer fee; a fixed, volume or volatility slippage."""

    commission: float = 3e-4
    stamp_sell: float = 5e-4
    transfer: float = 1e-5
    slippage: float = 5e-4
    kind: str = "fixed"

    def rate(self, delta: Column, nav: float, adv: Column, vol: Column) -> Column:
        """Cost of a weight change as a share of net asset value."""
        size = F.abs(delta)
        slip = {"fixed": F.lit(self.slippage), "volume": self.slippage * F.sqrt(size * nav / F.greatest(adv, F.lit(1.0))), "volatility": self.slippage * vol / 0.02}[self.kind]
        return size * (self.commission + self.transfer + slip) + F.when(delta < 0, size * self.stamp_sell).otherwise(0.0)


def generate_trades(weights: DataFrame, prices: DataFrame, capital: float = 1e6, model: CostModel = CostModel()) -> DataFrame:
    """Trades at every rebalance with costs; prices: date, ticker, close, adv, vol."""
    d = changes(weights).withColumn("delta", F.col("weight_to") - F.col("weight_from")).filter(F.abs("delta") > 1e-10)
    d = d.join(prices.select("date", "ticker", "close", "adv", "vol"), ["date", "ticker"]).filter("close > 0")
    d = d.withColumns({"side": F.when(F.col("delta") > 0, "buy").otherwise("sell"), "shares": F.bround(F.abs("delta") * capital / F.col("close"), 0)})
    d = d.withColumns({"adv": F.coalesce("adv", F.lit(1e6)), "vol": F.coalesce("vol", F.lit(0.02)), "notional": F.col("shares") * F.col("close")})
    return d.withColumns(model.columns(F.col("side"), F.col("shares"), F.col("close"), F.col("adv"), F.col("vol")))


def attribution(trades: DataFrame) -> DataFrame:
    """Sum, share and basis points of the traded notional of each kind of cost, and a TOTAL row."""
    kinds = ["commission", "slippage", "impact_cost", "fees", "stamp"]
    s = trades.agg(*[F.sum(k).alias(k) for k in kinds], F.sum("notional").alias("_n"), F.sum(sum((F.col(k) for k in kinds), F.lit(0.0))).alias("TOTAL"))
    long = s.unpivot(["_n"], [*kinds, "TOTAL"], "kind", "cost").crossJoin(F.broadcast(s.select(F.col("TOTAL").alias("_t"))))  # one row
    return long.select("kind", "cost", W.div(F.col("cost"), F.col("_t")).alias("share"), (W.div(F.col("cost"), F.col("_n")) * 1e4).alias("bps"))


def daily_pnl(weights: DataFrame, returns: DataFrame, costs: DataFrame, capital: float = 1e6, borrow_rate: float = 0.02) -> DataFrame:
    """Gross and net value by date.

    The value follows nav = nav * (1 + gross - borrow) - cost; with the running
    product P of the factors this is P * (capital - sum(cost / P)).  weights:
    daily; costs: date, cost.  One row a date by then, so one ordered window.
    """
    d = weights.join(returns.select("date", "ticker", "ret"), ["date", "ticker"], "left").groupBy("date").agg(
        F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("gross_ret"), F.sum(F.greatest(-F.col("weight"), F.lit(0.0))).alias("short_weight")
    )
    d = d.join(costs, "date", "left").withColumns({"cost": F.coalesce("cost", F.lit(0.0)), "borrow": F.col("short_weight") * borrow_rate / 252})
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_p": F.product(1 + F.col("gross_ret") - F.col("borrow")).over(w), "nav_gross": capital * F.product(1 + F.col("gross_ret")).over(w)})
    d = d.withColumn("nav_net", F.col("_p") * (capital - F.sum(W.div(F.col("cost"), F.col("_p"))).over(w)))
    d = d.withColumn("net_ret", W.div(F.col("nav_net"), F.coalesce(F.lag("nav_net").over(Window.orderBy("date")), F.lit(capital))) - 1)
    for k in ("gross", "net"):
        d = d.withColumn(f"drawdown_{k}", W.div(F.col(f"nav_{k}"), F.greatest(F.max(f"nav_{k}").over(w), F.lit(capital))) - 1)
    return d.drop("_p", "short_weight")


def performance(pnl: DataFrame, x: str = "net_ret") -> DataFrame:
    """Annualised return (geometric) and volatility, Sharpe, Sortino, Calmar, worst drawdown, hit rate."""
    r = F.col(x)
    ann = F.pow(F.product(1 + r), 252 / F.count(r)) - 1
    vol = F.stddev_samp(r) * math.sqrt(252)
    down = F.stddev_samp(F.when(r < 0, r)) * math.sqrt(252)
    dd = F.min("drawdown_net")
    return pnl.agg(
        ann.alias("ann_return"), vol.alias("ann_vol"), W.div(ann, vol).alias("sharpe"), W.div(ann, down).alias("sortino"), W.div(ann, F.abs(dd)).alias("calmar"), dd.alias("max_drawdown"),
        F.avg((r > 1e-12).cast("double")).alias("hit_rate"), F.count(r).alias("n"),
    )


def simulate_execution(weights: DataFrame, prices: DataFrame, capital: float = 1e6, model: CostModel = CostModel()) -> DataFrame:
    """Trades with capital compounding between rebalances: capital moves with last weights and pays for its trades.

    Whole shares and least commissions make each step depend on the last one, so
    one task folds, date by date, the bars of names held or traded on their date.
    Capital that leaves the range of a double is carried as a decimal: what passes
    1.8e308 is infinite in the result, and what comes back into range is right.
    """
    m = model

    def run(batches):
        cash, day, rows = capital, None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != day:
                    cash, out = _rebalance(day, rows, cash, m)
                    if out:
                        yield _batch(out)
                    day, rows = row[0], []
                rows.append(row)
        out = _rebalance(day, rows, cash, m)[1]
        if out:
            yield _batch(out)

    given, x = weights.filter(~F.isnan("weight")), F.col("weight")
    order = given.select("date").distinct().select("date", F.lead("date").over(Window.orderBy("date")).alias("_until"))  # one row a date
    target = given.join(F.broadcast(order), "date").select("date", "ticker", F.when(F.abs(x) > 1e-10, x).alias("_to"), "_until")
    close = F.when(F.abs("close") < math.inf, F.col("close"))
    d = prices.select("date", "ticker", close.alias("close"), "adv", "vol").join(target, ["date", "ticker"], "full_outer")
    before = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"_last": F.last("close", ignorenulls=True).over(before), "_held": F.last(F.when(F.col("_to").isNotNull(), F.struct("_to", "_until")), ignorenulls=True).over(before)})
    held = F.when(F.col("_held._until").isNull() | (F.col("date") <= F.col("_held._until")), F.col("_held._to"))  # held until the next rebalance
    d = d.join(F.broadcast(order.select("date", F.lit(True).alias("_trades"))), "date", "left").withColumn("_from", held)
    d = d.filter("close is not null and (_from is not null or _to is not null)").select("date", "ticker", "close", "_last", "_from", "_to", "_trades", "adv", "vol")
    return d.repartition(1).sortWithinPartitions("date", "ticker").mapInArrow(run, _TRADES)


_TRADES = "date date, ticker string, side string, shares double, price double, notional double, total_cost double, value_before double"


def _batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.date32(), pa.string(), pa.string(), *[pa.float64()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in _TRADES.split(", ")])


def _rebalance(day, rows: list[tuple], cash, m: CostModel) -> tuple:
    """Capital after a date, and its trades; rows: date, ticker, close, last close, weight before, weight wanted, whether it trades, adv, vol."""
    cash *= type(cash)(1 + sum(w * (price / last - 1) for _, _, price, last, w, *_ in rows if w is not None and last))
    # Costs grow faster than capital, so what is above zero turns into a decimal long before what is below.
    wide = cash > 1e100 or cash < -1e300
    num = Decimal if wide else float
    cash, spent, out = num(cash), num(0), []
    for _, t, price, _, old, new, trades, adv, vol in rows:
        delta = (new or 0.0) - (old or 0.0)
        if not trades or abs(delta) <= 1e-10 or not price > 0:
            continue
        # Half to even, and no integer of hundreds of digits.
        shares = num(abs(delta)) * cash / num(price)
        shares = shares.to_integral_value() if wide else round(shares, 0) + 0.0
        adv, vol = (default if x is None or x != x else x for x, default in ((adv, 1e6), (vol, 0.02)))
        n, cost = shares * num(price), num(0)
        if shares > 0:
            cost = max(shares * num(m.per_share), num(m.least_commission)) + n * num(m.slippage_bps) / num(1e4) + num(m.impact) * num(vol) * (shares / num(max(adv, 1.0))) ** num(m.impact_power) * n
            cost += n * num(m.sec_fee) + shares * num(m.taf_per_share) if delta < 0 else n * num(m.stamp_buy)
        spent += cost
        out.append((day, t, "buy" if delta > 0 else "sell", float(shares), price, float(n), round(float(cost), 4), float(cash)))
    return cash - spent, out


def capacity_curve(trades: DataFrame, pnl: DataFrame, scales: tuple[float, ...] = (1.0, 5.0, 10.0, 50.0), capital: float = 1e6, model: CostModel = CostModel()) -> DataFrame:
    """Costs and net Sharpe with the same trades at larger capital; a few scales, so rows times a few."""
    d = trades.select("date", "side", "shares", "close", "adv", "vol", F.explode(F.array(*map(F.lit, scales))).alias("scale"))
    d = d.withColumn("shares", F.col("shares") * F.col("scale"))
    cost = model.columns(F.col("side"), F.col("shares"), F.col("close"), F.col("adv"), F.col("vol"))["total_cost"]
    daily = d.withColumn("c", cost).groupBy("scale", "date").agg(F.sum("c").alias("c"), F.max(W.div(F.col("shares"), F.col("adv"))).alias("part"))
    grid = pnl.select("date", "gross_ret", F.explode(F.array(*map(F.lit, scales))).alias("scale"))
    r = grid.join(daily, ["scale", "date"], "left").withColumn("net", F.col("gross_ret") - F.coalesce("c", F.lit(0.0)) / (F.col("scale") * capital))
    return r.groupBy("scale").agg((W.div(F.avg("net"), F.stddev_samp("net")) * math.sqrt(252)).alias("net_sharpe"), F.sum("c").alias("cost"), F.percentile("part", F.lit(0.95)).alias("participation_p95"))
