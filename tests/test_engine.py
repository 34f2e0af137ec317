import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom import registry
from quantloom.operators import alpha, analytics, costs, evaluation, factors, kernels, portfolio, risk_model, transforms
from quantloom.sources import data
from quantloom.streaming import live

DAY = datetime.date(2023, 1, 2)


def panel(spark, n=90, tickers=6, seed=42):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(tickers):
        p = 100.0 * np.cumprod(1 + r.normal(0, 0.02, n))
        for i in range(n):
            rows.append((DAY + datetime.timedelta(i), f"T{k}", float(p[i]), float(p[i] * 1.02), float(p[i] * 0.98), 1e6 + i, float(p[i]) * 1e6, float(p[i] / p[i - 1] - 1) if i else None))
    return spark.createDataFrame(rows, "date date, ticker string, close double, high double, low double, volume double, amount double, ret double")


def test_all_factors_in_one_frame_keep_the_rows(spark):
    p = panel(spark)
    d = factors.compute(p, list(factors.FACTORS))
    assert d.count() == p.count() and len(d.columns) == 2 + len(factors.FACTORS)
    assert len(factors.FACTORS) + len(kernels.KERNELS) + 4 == 38


def test_idiovol_matches_least_squares(spark):
    p = panel(spark)
    got = {(r.date, r.ticker): r.IDIOVOL for r in factors.compute(p, ["IDIOVOL"], lagged=False).collect()}
    pdf = p.toPandas().pivot(index="date", columns="ticker", values="ret")
    y, m, i = pdf["T0"].to_numpy(), pdf.mean(axis=1).to_numpy(), 80
    a, b = m[i - 60 : i], y[i - 60 : i]
    res = b - np.polyval(np.polyfit(a, b, 1), a)
    assert math.isclose(got[pdf.index[i], "T0"], res.std(ddof=1) * math.sqrt(252), rel_tol=1e-9)


def test_kernels_against_plain_loops():
    r = np.random.default_rng(0).normal(0, 0.01, 80)
    x = r[20:80]
    power = [abs(sum(x[j] * np.exp(-2j * math.pi * k * j / 60) for j in range(60))) ** 2 for k in range(30)]
    p = np.array(power) / sum(power)
    assert math.isclose(kernels.spectral_entropy(r)[79], -(p * np.log(p)).sum() / math.log(30), rel_tol=1e-9)
    rs = []
    for size in (8, 16):
        v = []
        for b in range(60 // size):
            s = x[b * size : (b + 1) * size]
            c = np.cumsum(s - s.mean())
            v.append((c.max() - c.min()) / s.std())
        rs.append(np.mean(v))
    assert math.isclose(kernels.hurst(r)[79], math.log2(rs[1] / rs[0]), rel_tol=1e-9)
    price = np.linspace(100, 120, 60)
    level, slope = kernels.kalman(price)
    assert abs(level[-1] - 120) < 0.5 and abs(slope[-1] - 20 / 59) < 0.05
    calm = np.concatenate([np.random.default_rng(1).normal(0, 0.002, 150), np.random.default_rng(2).normal(0, 0.05, 60)])
    t = kernels.turbulence(100 * np.cumprod(1 + calm))
    assert np.nanmean(t[:140]) < 0.2 < 0.8 < np.nanmean(t[160:])


def test_planted_factor_has_perfect_rank_ic(spark):
    rows = [(DAY + datetime.timedelta(i), f"T{k:02d}", float(k), k / 1000) for i in range(30) for k in range(12)]
    d = spark.createDataFrame(rows, "date date, ticker string, x double, fwd double")
    ic = evaluation.ic_series(d, "x", "fwd")
    assert {round(r.ic, 9) for r in ic.collect()} == {1.0}
    bins = evaluation.quantile_returns(d, "x", "fwd")
    assert evaluation.monotonicity(bins).first().monotonicity == pytest.approx(1.0)
    assert [r.n for r in bins.filter(F.col("date") == DAY).orderBy("bin").collect()] == [3, 2, 2, 2, 3]


def test_effective_signal_flips_direction(spark):
    d = spark.createDataFrame([(DAY, "A", 3.0), (DAY, "B", 2.0), (DAY, "C", 1.0)], "date date, ticker string, x double")
    got = {r.ticker: r.x for r in transforms.effective_signal(d, "x", -1).collect()}
    assert got["C"] == 1.0 > got["B"] > got["A"]


def test_constant_date_has_zero_zscore(spark):
    d = spark.createDataFrame([(DAY, t, 5.0) for t in "ABC"], "date date, ticker string, x double")
    assert {r.x for r in transforms.zscore(d, "x").collect()} == {0.0}


def test_two_day_execution_and_borrow(spark):
    rows = [(DAY, "A", 100.0, 1.0), (DAY, "B", 100.0, None), (DAY + datetime.timedelta(1), "A", 200.0, None), (DAY + datetime.timedelta(1), "B", 100.0, 1.0)]
    w = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows if r[3]], "date date, ticker string, weight double")
    px = spark.createDataFrame([(r[0], r[1], r[2], None, None) for r in rows], "date date, ticker string, close double, adv double, vol double")
    free = costs.CostModel(per_share=0, least_commission=0, slippage_bps=0, impact=0, sec_fee=0, taf_per_share=0)
    t = costs.simulate_execution(w, px, 1000.0, free).filter(F.col("date") > DAY).collect()
    assert {r.value_before for r in t} == {2000.0} and max(r.notional for r in t) == 2000.0
    days = [DAY + datetime.timedelta(i) for i in range(2)]
    short = spark.createDataFrame([(x, "A", -1.0) for x in days], "date date, ticker string, weight double")
    flat = spark.createDataFrame([(x, "A", 0.0) for x in days], "date date, ticker string, ret double")
    none = spark.createDataFrame([], "date date, cost double")
    p = costs.daily_pnl(short, flat, none, 1000.0, 0.252).orderBy("date").collect()
    assert p[0].nav_net == pytest.approx(999.0) and p[0].nav_net - p[1].nav_net < 1.0


def test_nav_closed_form_matches_recursion(spark):
    r = np.random.default_rng(3)
    days = [DAY + datetime.timedelta(i) for i in range(40)]
    g, c = r.normal(0, 0.01, 40), r.uniform(0, 50, 40)
    w = spark.createDataFrame([(x, "A", 1.0) for x in days], "date date, ticker string, weight double")
    ret = spark.createDataFrame([(x, "A", float(v)) for x, v in zip(days, g)], "date date, ticker string, ret double")
    cost = spark.createDataFrame([(x, float(v)) for x, v in zip(days, c)], "date date, cost double")
    nav, want = 1e4, []
    for a, b in zip(g, c):
        nav = nav * (1 + a) - b
        want.append(nav)
    got = [x.nav_net for x in costs.daily_pnl(w, ret, cost, 1e4).orderBy("date").collect()]
    assert np.allclose(got, want)


def test_turnover_clip_and_constraints(spark):
    rows = [(DAY, "A", 1.0), (DAY + datetime.timedelta(30), "B", 1.0)]
    w = spark.createDataFrame(rows, "date date, ticker string, weight double")
    got = {(r.date, r.ticker): r.weight for r in portfolio.clip_turnover(w, 0.25).collect()}
    assert got[rows[1][0], "B"] == pytest.approx(0.25) and got[rows[1][0], "A"] == pytest.approx(0.75)
    assert portfolio.violations(w).count() == 0


def test_risk_model_recovers_beta(spark):
    r = np.random.default_rng(5)
    m = r.normal(0, 0.01, 250)
    rows = [(DAY + datetime.timedelta(i), f"T{b}", float(b * m[i] + r.normal(0, 0.0005)), float(m[i])) for i in range(250) for b in (1, 2)]
    d = spark.createDataFrame(rows, "date date, ticker string, ret double, mkt double")
    got = {x.ticker: x.beta for x in risk_model.exposures(d).collect()}
    assert got["T1"] == pytest.approx(1, abs=0.02) and got["T2"] == pytest.approx(2, abs=0.02)
    w = risk_model.mean_variance(np.array([0.1, 0.0, 0.0, 0.0]), np.eye(4) * 0.01, cap=0.6)
    assert w.sum() == pytest.approx(1) and w[0] == pytest.approx(0.6, abs=1e-6)


def test_walk_forward_matches_refits(spark):
    r = np.random.default_rng(6)
    rows = [(DAY + datetime.timedelta(i), f"T{k}", *map(float, r.normal(size=2)), 0.0) for i in range(60) for k in range(5)]
    rows = [(a, b, x, z, 0.5 * x - 0.2 * z + float(r.normal(0, 0.01))) for a, b, x, z, _ in rows]
    d = spark.createDataFrame(rows, "date date, ticker string, a double, b double, y double")
    got = {(x.date, x.ticker): x.prediction for x in alpha.walk_forward(d, ["a", "b"], "y", first=40, every=10).collect()}
    assert len(got) == 100
    assert all(abs(got[x[0], x[1]] - (0.5 * x[2] - 0.2 * x[3])) < 0.05 for x in rows if (x[0], x[1]) in got)


def test_scalars():
    assert analytics.student_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-6)
    assert analytics.kupiec(5, 100)[1] == pytest.approx(1.0)
    assert evaluation.p_value(1.959963984540054) == pytest.approx(0.05)
    assert 0 <= analytics.deflated_sharpe(0.1, 20, 250) <= 1
    assert alpha.clusters([("a", "b", 0.9), ("b", "c", 0.1)], ["a", "b", "c"]) == {"a": 0, "b": 0, "c": 1}


def test_upsert_schema_and_gate(spark):
    old = spark.createDataFrame([(DAY, "A", 100.0), (DAY, "B", 100.0)], "date date, ticker string, adj_close double")
    got = data.upsert(old, spark.createDataFrame([(DAY, "A", 95.0)], old.schema)).collect()
    assert {(r.ticker, r.adj_close) for r in got} == {("A", 95.0), ("B", 100.0)}
    with pytest.raises(ValueError):
        data.check_columns(old, ["date", "ticker"])
    ts = datetime.datetime(2023, 1, 2, 10)
    o = spark.createDataFrame([("x", ts, i, 100.0, 100.0) for i in range(4)], "account string, ts timestamp, event_id long, shares double, price double")
    r = sorted((x.event_id, x.reason) for x in live.gate(o, live.RiskLimits(most_trades=2)).collect())
    assert [x[1] for x in r] == ["ok", "ok", "trades", "trades"]


def test_flagship_and_registry(spark):
    assert registry.flagship(spark, "/root/testdata/sf0.001").count() > 100
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
