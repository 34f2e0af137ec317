"""Results that outgrow a double, and series fitted side by side."""

import datetime
import math
import time

import numpy as np
import pytest

from quantloom.operators import costs, kernels

DAY = datetime.date(2020, 1, 1)


def test_capital_beyond_a_double_and_back(spark):
    # Two prices change places each day; 32 days on the rising one, then 3 on the falling one.
    days = [DAY + datetime.timedelta(i) for i in range(36)]
    px = [(x, t, 1e10 if (i + k) % 2 else 1.0, None, None) for i, x in enumerate(days) for k, t in enumerate("AB")]
    w = [(x, "AB"[i % 2 if i < 32 else 1 - i % 2], 1.0) for i, x in enumerate(days)]
    free = costs.CostModel(per_share=0, least_commission=0, slippage_bps=0, impact=0, sec_fee=0, taf_per_share=0)
    t = costs.simulate_execution(spark.createDataFrame(w, "date date, ticker string, weight double"), spark.createDataFrame(px, "date date, ticker string, close double, adv double, vol double"), 1e3, free).collect()
    value = {r.date: r.value_before for r in t}
    assert len(t) == 1 + 2 * 34 and value[days[30]] == pytest.approx(1e303)
    assert value[days[31]] == math.inf and value[days[35]] == pytest.approx(1e293)
    assert {r.total_cost for r in t} == {0.0} and not any(math.isnan(r.shares) for r in t)


def test_turbulence_of_many_series_side_by_side():
    r = np.random.default_rng(5)
    series = [100 * np.cumprod(1 + r.normal(0, 0.01, n) * np.where(r.random(n) < 0.1, 5, 1)) for n in r.integers(100, 260, 400)]
    series[3][50], series[7][60], series[11][:] = np.nan, 0.0, 5.0
    alone, began = [], time.perf_counter()
    for p in series[:20]:
        alone.append(kernels.turbulence(p))
    once = (time.perf_counter() - began) / 20
    began = time.perf_counter()
    got = kernels.turbulences(series)
    assert time.perf_counter() - began < 100 * once  # one after another: 400 times
    assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(alone, got))
    assert all(np.isnan(g).all() for g, p in zip(got, series) if len(p) < 121)


def test_kernels_do_not_depend_on_how_tickers_are_batched(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(DAY + datetime.timedelta(i), t, float(v)) for t in ["A", "B", "C", "D", None] for i, v in enumerate(np.exp(r.normal(0, 0.1, 140)))]
    p = spark.createDataFrame(rows[::-1], "date date, ticker string, close double").repartition(3)
    names = ["HMM_TURBULENCE_PROB", "ACF_DECAY_60D"]
    whole = sorted(map(repr, kernels.compute(p, names).collect()))
    monkeypatch.setattr(kernels, "ROWS", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert sorted(map(repr, kernels.compute(p, names).collect())) == whole and len(whole) == 700
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last = {r.ticker: r for r in kernels.compute(p, names, lag=0).collect() if r.date == DAY + datetime.timedelta(139)}
    for t in last:
        price = np.array([v for _, u, v in rows if u == t])
        assert last[t].HMM_TURBULENCE_PROB == kernels.turbulence(price)[-1]
        assert last[t].ACF_DECAY_60D == kernels.acf_decay(kernels.simple_returns(price))[-1]
