import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.operators import alpha, scorecards as S
from quantloom.sources import preparation as PR


def days(n):
    return [dt.date(2023, 1, 2) + dt.timedelta(days=i) for i in range(n)]


@pytest.fixture(scope="module")
def planted(spark):
    """Two factors on 30 days and 12 names: GOOD orders the returns, BAD reverses them."""
    rows = [(d, f"T{i:02d}", f, float(i if f == "GOOD" else -i), i / 1000, i / 800) for d in days(30) for i in range(12) for f in ("GOOD", "BAD")]
    return spark.createDataFrame(rows, "date date, ticker string, factor string, value double, fwd_1 double, fwd_5 double")


def test_tear_sheet_of_a_planted_factor(planted):
    got = {r.factor: r for r in S.tear_sheet(planted, (1, 5)).collect()}
    assert got["GOOD"].ric_mean == pytest.approx(1.0) and got["BAD"].ric_mean == pytest.approx(-1.0)
    assert got["GOOD"].monotonicity == pytest.approx(1.0) and got["GOOD"].sign_consistency == 1.0
    assert got["GOOD"].mean_turnover == pytest.approx(0.0)


def test_folds_pick_the_better_factor(spark, planted):
    from quantloom.operators import evaluation as E

    ic = E.ic_series(planted, "value", "fwd_1", by=("date", "factor"))
    folds = spark.createDataFrame([(0, days(1)[0], days(15)[-1], days(30)[-1])], "fold int, train_start date, train_end date, test_end date")
    chosen = S.select_per_fold(ic, folds, 1)
    assert [r.factor for r in chosen.collect()] == ["GOOD"]
    r = S.fold_portfolios(planted, folds, chosen).first()
    assert r.n == 15 and r.max_drawdown == 0.0 and r.ann_return > 0


def test_regime_overlay_cuts_exposure(spark):
    market = spark.createDataFrame([(d, 0.01 if i % 3 else -0.04) for i, d in enumerate(days(60))], "date date, mkt double")
    prob = market.select("date", F.when(F.col("mkt") < 0, 0.9).otherwise(0.1).alias("prob"))
    r = S.regime(market, prob).first()
    assert r.overlay_sharpe > r.baseline_sharpe and r.overlay_max_dd < r.baseline_max_dd
    assert r.detection_rate == pytest.approx(1 / 3) and r.exposure_reduction == pytest.approx(0.3)


def test_calendar_around_a_weekend(spark):
    cal = spark.createDataFrame([(dt.date(2023, 1, 6),), (dt.date(2023, 1, 9),)], "date date")
    d = spark.createDataFrame([(dt.date(2023, 1, k),) for k in (6, 7, 9, 10)], "date date")
    assert [r.is_session for r in PR.is_session(d, cal).orderBy("date").collect()] == [True, False, True, False]
    assert [r.prev and r.prev.day for r in PR.previous_session(d, cal).orderBy("date").collect()] == [None, 6, 6, 9]
    assert PR.align_inner(d, cal).count() == 2
    f = spark.createDataFrame([("A", dt.date(2023, 1, 4)), ("B", dt.date(2023, 1, 8)), ("C", dt.date(2023, 1, 9))], "ticker string, publish_date date")
    assert {r.ticker: r.date and r.date.day for r in PR.available(f, cal).collect()} == {"A": 6, "B": None, "C": None}


def test_market_rules_and_lots(spark):
    r = spark.range(1).select(PR.lots(F.lit(1250.0), "cn").alias("cn"), PR.lots(F.lit(12.7), "us").alias("us")).first()
    assert (r.cn, r.us) == (1200, 12) and not PR.RULES["cn"].short_selling and PR.RULES["us"].settlement_days == 2


def test_orthogonal_part_of_a_line_is_zero(spark):
    rows = [(d, f"T{i}", float(i), 3.0 + 2.0 * i) for d in days(2) for i in range(12)]
    f = spark.createDataFrame(rows, "date date, ticker string, b double, v double")
    got = S.orthogonal(f.select("date", "ticker", F.col("v").alias("value")), f.select("date", "ticker", F.col("b").alias("value"))).collect()
    assert len(got) == 24 and all(abs(r.value) < 1e-9 for r in got)


def test_adjusted_p_values(spark):
    d = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.9)], "factor string, p double")
    got = {r.factor: (round(r.bh, 6), round(r.bonferroni, 6)) for r in alpha.adjust_p(d).collect()}
    assert got == {"a": (0.04, 0.04), "b": (0.04, 0.08), "c": (0.04, 0.12), "d": (0.9, 1.0)}
