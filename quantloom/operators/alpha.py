"""Selection, redundancy, combination of factors, and learned alphas.

Panels are reduced to (date, factor) or factor-pair rows by Spark; only such
reduced tables (dates times factors at most) reach numpy.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from .evaluation import ic_series


def adjust_p(df: DataFrame, p: str = "p") -> DataFrame:
    """Benjamini-Hochberg and Bonferroni values of a column of p-values (one row a factor)."""
    m, r = F.count(p).over(Window.partitionBy()), F.row_number().over(Window.orderBy(p, "factor"))
    d = df.withColumns({"_m": m, "_r": r})
    low = F.min(F.col(p) * F.col("_m") / F.col("_r")).over(Window.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumns({"bh": F.least(F.lit(1.0), low), "bonferroni": F.least(F.lit(1.0), F.col(p) * F.col("_m"))}).drop("_m", "_r")


def reality_check(panel: np.ndarray, draws: int = 500, seed: int = 42) -> float:
    """Share of date bootstraps whose best demeaned mean reaches the best mean; panel: dates x factors."""
    x = panel[~np.isnan(panel).any(axis=1)]
    if not len(x):
        return float("nan")
    rng, centred = np.random.default_rng(seed), x - x.mean(axis=0)
    best = [centred[rng.integers(0, len(x), len(x))].mean(axis=0).max() for _ in range(draws)]
    return float(np.mean(np.array(best) >= x.mean(axis=0).max()))


def deployable(df: DataFrame, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """passes, score (share of rules met) and deployable; rules: column to (">=" or "<=", bound)."""
    tests = [F.coalesce((F.col(c) >= b) if op == ">=" else (F.col(c) <= b), F.lit(False)).cast("int") for c, (op, b) in rules.items()]
    n = sum(tests, F.lit(0))
    return df.withColumns({"passes": n, "score": n / len(tests), "deployable": n == len(tests)})


def factor_correlation(long: DataFrame, ranked: bool = True) -> DataFrame:
    """f1 < f2, corr and n of all pairs of a long frame (date, ticker, factor, value) over the rows both have."""
    d = long.filter("value is not null")
    if ranked:
        d = d.withColumn("value", W.rank_pct(F.col("value"), "date", "factor"))
    a, b = d.select("date", "ticker", F.col("factor").alias("f1"), F.col("value").alias("x")), d.select("date", "ticker", F.col("factor").alias("f2"), F.col("value").alias("y"))
    pairs = a.join(b, ["date", "ticker"]).filter("f1 < f2")
    return pairs.groupBy("f1", "f2").agg(W.corr(F.col("x"), F.col("y")).alias("corr"), F.count("*").alias("n"))


def cosine(long: DataFrame) -> DataFrame:
    a, b = (long.select("date", "ticker", F.col("factor").alias(f), F.coalesce("value", F.lit(0.0)).alias(v)) for f, v in (("f1", "x"), ("f2", "y")))
    d = a.join(b, ["date", "ticker"]).filter("f1 < f2").groupBy("f1", "f2")
    return d.agg(W.div(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))).alias("cosine"))


def clusters(pairs: list[tuple[str, str, float]], names: list[str], threshold: float = 0.7) -> dict[str, int]:
    """Cluster number of each factor: joined where |similarity| reaches the threshold (a few dozen factors)."""
    root = {n: n for n in names}

    def find(x: str) -> str:
        while root[x] != x:
            x = root[x]
        return x

    for a, b, v in pairs:
        if v is not None and abs(v) >= threshold:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    order = sorted({find(n) for n in names})
    return {n: order.index(find(n)) for n in names}


def select_complementary(returns: np.ndarray, names: list[str], score: dict[str, float], corr: dict[tuple[str, str], float], limit: float = 0.7, most: int = 10) -> list[str]:
    """Greedy by score: a factor enters if it is not too close to those chosen and its return over their fit has a positive information ratio."""
    chosen: list[str] = []
    for n in sorted(names, key=lambda x: (-score.get(x, -math.inf), x)):
        if len(chosen) >= most or any(abs(corr.get((min(n, c), max(n, c)), 0.0)) >= limit for c in chosen):
            continue
        y = returns[:, names.index(n)]
        if chosen:
            x = np.column_stack([np.ones(len(y)), returns[:, [names.index(c) for c in chosen]]])
            beta = np.linalg.lstsq(x, y, rcond=None)[0]
            sd = (y - x @ beta).std(ddof=1)
            if sd > 0 and beta[0] / sd < 0:
                continue
        chosen.append(n)
    return chosen


def combine_icir(long: DataFrame, n: int = 126, least: int = 40) -> DataFrame:
    """date, factor, weight: positive rolling ICIR of the last n dates, lagged by one, summing to 1; equal where none is positive.

    long: date, ticker, factor, value, fwd.
    """
    ic = ic_series(long, "value", "fwd", by=("date", "factor"))
    w = Window.partitionBy("factor").orderBy("date")
    frame = w.rowsBetween(1 - n, 0)
    raw = F.when(F.count("ic").over(frame) >= least, W.div(F.avg("ic").over(frame), F.stddev_samp("ic").over(frame)))
    return _normalised(ic.withColumn("_w", raw).withColumn("_w", F.greatest(F.lag("_w").over(w), F.lit(0.0))))


def combine_inverse_risk(ls: DataFrame, n: int = 126, least: int = 40) -> DataFrame:
    """date, factor, weight in proportion to 1 / rolling deviation of the factor's long-short return (ls)."""
    w = Window.partitionBy("factor").orderBy("date")
    frame = w.rowsBetween(1 - n, 0)
    raw = F.when(F.count("ls").over(frame) >= least, W.div(F.lit(1.0), F.nullif(F.stddev_samp("ls").over(frame), F.lit(0.0))))
    return _normalised(ls.withColumn("_w", raw).withColumn("_w", F.lag("_w").over(w)))


def _normalised(d: DataFrame) -> DataFrame:
    day = Window.partitionBy("date")
    total = F.sum("_w").over(day)
    return d.select("date", "factor", F.when(total > 0, F.coalesce("_w", F.lit(0.0)) / F.nullif(total, F.lit(0.0))).otherwise(1.0 / F.count("*").over(day)).alias("weight"))


def combine_mean_variance(ls: DataFrame, n: int = 126, least: int = 40, ridge: float = 1e-4) -> DataFrame:
    """date, factor, weight from (cov + ridge)^-1 mean of the trailing long-short returns; dates times factors in one fold."""
    import pandas as pd

    def run(pdf):
        x = pdf.pivot(index="date", columns="factor", values="ls").sort_index()
        v, rows = x.to_numpy(float), []
        for i in range(len(x)):
            past = v[max(0, i - n) : i]
            past = past[~np.isnan(past).any(axis=1)]
            k = v.shape[1]
            w = np.full(k, 1 / k)
            if len(past) >= least:
                raw = np.maximum(np.linalg.solve(np.atleast_2d(np.cov(past.T)) + ridge * np.eye(k), past.mean(axis=0)), 0)
                w = raw / raw.sum() if raw.sum() > 0 else w
            rows += [(x.index[i], f, float(a)) for f, a in zip(x.columns, w)]
        return pd.DataFrame(rows, columns=["date", "factor", "weight"])

    return ls.select("date", "factor", "ls", F.lit(1).alias("_p")).groupBy("_p").applyInPandas(run, "date date, factor string, weight double")


def alpha_signal(long: DataFrame, weights: DataFrame) -> DataFrame:
    d = long.join(weights, ["date", "factor"])
    return d.groupBy("date", "ticker").agg(F.sum(F.col("weight") * F.coalesce("value", F.lit(0.0))).alias("alpha"))


def weighted_rank(long: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Mean over the factors a name has of weight times value."""
    m = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])
    return long.groupBy("date", "ticker").agg(F.avg(F.col("value") * F.try_element_at(m, F.col("factor"))).alias("score"))


def overlay(signal: DataFrame, prob: DataFrame, x: str, limit: float = 0.6, scale: float = 0.5) -> DataFrame:
    """Scale x on dates whose mean turbulence probability passes the limit."""
    p = prob.groupBy("date").agg(F.avg("prob").alias("_p"))
    return signal.join(p, "date", "left").withColumn(x, F.when(F.col("_p") > limit, F.col(x) * scale).otherwise(F.col(x))).drop("_p")


def purged_folds(dates: DataFrame, n: int = 5, embargo: int = 5) -> DataFrame:
    """date, fold, part: n + 1 equal blocks; fold k trains on the blocks before block k less the embargo and tests on it."""
    w = Window.orderBy("date")
    d = dates.select("date").distinct().withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy())})
    size = F.floor(F.col("_n") / (n + 1))
    d = d.withColumns({"_s": size, "fold": F.explode(F.sequence(F.lit(1), F.lit(n)))})
    start = F.col("fold") * F.col("_s")
    end = F.when(F.col("fold") == n, F.col("_n")).otherwise(start + F.col("_s"))
    part = F.when(F.col("_i") < start - embargo, "train").when((F.col("_i") >= start) & (F.col("_i") < end), "test")
    return d.select("date", "fold", part.alias("part")).filter("part is not null")


def moments(d: DataFrame, xs: list[str], y: str, by: str = "date") -> DataFrame:
    """Sums that any refit needs, per group: count, sums, cross products.  k features give (k + 1)(k + 2) / 2 + 1 sums."""
    cols = [F.lit(1.0), *[F.col(x) for x in xs], F.col(y)]
    ok = d.dropna(subset=[*xs, y])
    sums = [F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return ok.groupBy(by).agg(*sums)


def fit_from_moments(m: dict, k: int, kind: str = "ridge", alpha: float = 1.0, l1_ratio: float = 0.5) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """(coefficients of standardised features, intercept, means, deviations) of ridge, lasso or elastic net."""
    g = np.zeros((k + 2, k + 2))
    for i in range(k + 2):
        for j in range(i, k + 2):
            g[i, j] = g[j, i] = m[f"s{i}_{j}"]
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
    sd = np.where(sd > 0, sd, 1.0)
    xx, xy = cov[:k, :k] / np.outer(sd, sd), cov[:k, k] / sd
    if kind == "ridge":
        return np.linalg.solve(xx + alpha / n * np.eye(k), xy), float(mean[k]), mean[:k], sd
    l1, l2 = (alpha, 0.0) if kind == "lasso" else (alpha * l1_ratio, alpha * (1 - l1_ratio))
    b = np.zeros(k)
    for _ in range(1000):
        before = b.copy()
        for j in range(k):
            rest = xy[j] - xx[j] @ b + xx[j, j] * b[j]
            b[j] = np.sign(rest) * max(abs(rest) - l1, 0) / max(xx[j, j] + l2, 1e-12)
        if np.abs(b - before).max() < 1e-10:
            break
    return b, float(mean[k]), mean[:k], sd


def walk_forward(d: DataFrame, xs: list[str], y: str, first: int = 252, every: int = 21, kind: str = "ridge", alpha: float = 1.0) -> DataFrame:
    """Predictions of models refitted every ``every`` dates on all dates before (``first`` at least).

    Sums of products by date come from one aggregation; running totals give
    every refit, so the panel is read once and not once a refit.
    """
    rows = moments(d, xs, y).orderBy("date").toPandas()  # one row a date
    names = [c for c in rows.columns if c != "date"]
    total, fits = rows[names].cumsum(), []
    for i in range(first, len(rows), every):
        b, c, mean, sd = fit_from_moments(total.iloc[i - 1].to_dict(), len(xs), kind, alpha)
        slope = b / sd
        until = rows["date"].iloc[min(i + every, len(rows)) - 1]
        fits.append((rows["date"].iloc[i], until, float(c - slope @ mean), [float(v) for v in slope]))
    spark = d.sparkSession
    table = spark.createDataFrame(fits, "_start date, _until date, _c double, _b array<double>")
    j = d.join(F.broadcast(table), (F.col("date") >= F.col("_start")) & (F.col("date") <= F.col("_until")))
    score = sum((F.col(x) * F.get("_b", i) for i, x in enumerate(xs)), F.col("_c"))
    return j.select("date", "ticker", score.alias("prediction"))


def tune(panel: DataFrame, build, grid: list, fwd: str) -> DataFrame:
    """Mean rank IC of every variant: all variants are columns of one frame, made long and evaluated together."""
    d = panel.select("date", "ticker", fwd, *[build(g).alias(f"v{i}") for i, g in enumerate(grid)])
    long = d.unpivot(["date", "ticker", fwd], [f"v{i}" for i in range(len(grid))], "variant", "value")
    ic = ic_series(long, "value", fwd, by=("variant", "date"))
    return ic.groupBy("variant").agg(F.avg("ic").alias("mean_ic"), W.div(F.avg("ic"), F.stddev_samp("ic")).alias("ir"), F.count("ic").alias("n"))

