"""Live quotes: latest snapshot, bars, target orders and a pre-trade risk gate on Structured Streaming."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RiskLimits:
    most_notional: float = 50_000.0
    most_session_notional: float = 500_000.0
    most_trades: int = 200
    least_price: float = 0.0


def quotes(spark: SparkSession, path: str) -> DataFrame:
    """events below path as a stream of symbol, ts, event_id, price."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))


def snapshot(q: DataFrame) -> DataFrame:
    """Last price of each symbol; the latest time wins, then the largest event_id."""
    return q.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"), F.count("*").alias("n"))


def bars(q: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Open, high, low, close and count by event time; late rows beyond the watermark are left out."""
    w = q.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "symbol")
    order = F.struct("ts", "event_id")
    return w.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "symbol", "open", "high", "low", "close", "n")


def rebalance_orders(targets: DataFrame, positions: DataFrame, prices: DataFrame, capital: float, least: float = 500.0) -> DataFrame:
    """Orders from positions to target weights: whole shares towards zero, small ones skipped."""
    d = targets.join(positions, "symbol", "full_outer").join(prices, "symbol").filter("price > 0")
    want = (F.coalesce("weight", F.lit(0.0)) * capital / F.col("price")).cast("long")
    d = d.withColumn("shares", want - F.coalesce("position", F.lit(0)).cast("long"))
    return d.filter((F.col("shares") != 0) & (F.abs(F.col("shares") * F.col("price")) >= least)).select("symbol", "shares", "price", F.when(F.col("shares") > 0, "buy").otherwise("sell").alias("side"))


def gate(orders: DataFrame, limits: RiskLimits = RiskLimits()) -> DataFrame:
    """accepted and reason of each order, per account and day in order of event_id.

    Acceptance depends on what was accepted before, so a stateful operator
    keeps the account's counters and resets them when the day changes.  Works on
    a stream and on a table.  orders: account, ts, event_id, shares, price.
    """
    import pandas as pd

    def step(rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
        day, trades, notional = state
        out = []
        for r in rows.sort_values(["ts", "event_id"]).itertuples():
            today = r.ts.date().isoformat()
            if today != day:
                day, trades, notional = today, 0, 0.0
            n = abs(r.shares * r.price)
            reason = (
                "price" if not r.price > limits.least_price else "shares" if r.shares == 0 else "notional" if n > limits.most_notional
                else "trades" if trades >= limits.most_trades else "session" if notional + n > limits.most_session_notional else "ok"
            )
            if reason == "ok":
                trades, notional = trades + 1, notional + n
            out.append((r.account, r.event_id, reason == "ok", reason))
        return pd.DataFrame(out, columns=["account", "event_id", "accepted", "reason"]), (day, trades, notional)

    schema = "account string, event_id long, accepted boolean, reason string"
    if not orders.isStreaming:
        # The counters start again each day, so a day is a group of its own.
        return orders.groupBy("account", F.to_date("ts")).applyInPandas(lambda pdf: step(pdf, ("", 0, 0.0))[0], schema)

    def stateful(key, chunks, state):
        now = state.get if state.exists else ("", 0, 0.0)
        rows = list(chunks)
        if rows:
            out, now = step(pd.concat(rows), tuple(now))
            state.update(now)
            yield out

    return orders.groupBy("account").applyInPandasWithState(stateful, schema, "day string, trades long, notional double", "append", "NoTimeout")


def positions(fills: DataFrame) -> DataFrame:
    """symbol, position and the average price of what was bought; fills: symbol, shares (negative: sold), price."""
    bought = F.when(F.col("shares") > 0, F.col("shares"))
    return fills.groupBy("symbol").agg(F.sum("shares").alias("position"), F.try_divide(F.sum(bought * F.col("price")), F.sum(bought)).alias("average_cost"))


def exposure(held: DataFrame, prices: DataFrame) -> DataFrame:
    """One row: net and gross value of the positions."""
    value = F.col("position") * F.col("price")
    return held.join(prices, "symbol").agg(F.sum(value).alias("net"), F.sum(F.abs(value)).alias("gross"))


def orders(trades: DataFrame, kind: str = "MKT", bps: float = 10.0) -> DataFrame:
    """Orders for trades (shares, price): side, quantity, kind, and for LMT a limit bps beyond the price, down to a cent."""
    buy = F.col("shares") > 0
    limit = F.floor(F.col("price") * (1 + F.when(buy, bps).otherwise(-bps) / 1e4) * 100) / 100
    return trades.withColumns({"side": F.when(buy, "buy").otherwise("sell"), "quantity": F.abs("shares").cast("long"), "kind": F.lit(kind), "limit_price": limit if kind == "LMT" else F.lit(None).cast("double")})


def append_fills(fills: DataFrame, path: str) -> None:
    """Fills at the end of the log below path."""
    fills.write.mode("append").parquet(path)


def run_to_end(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Everything that is there now, as a table of the memory sink."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
