"""Factors that are recursions or spectra: whole tickers a call, vectorised over a ticker's windows or over many tickers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 60
#: Rows of whole tickers that are worked on together, and returns of them that are fitted side by side.
ROWS, SIDE_BY_SIDE = 400_000, 400_000


def kalman(price: np.ndarray, q: float = 1e-5, r: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(filtered price, velocity) of a constant-velocity filter on the min-max scaled series."""
    low, span = float(np.nanmin(price)), float(np.nanmax(price) - np.nanmin(price))
    span = span if span > 0 else 1.0
    z = (price - low) / span
    level, slope = z[0], 0.0
    p00, p01, p11 = 1.0, 0.0, 1.0
    out, vel = np.empty(len(z)), np.empty(len(z))
    for i, obs in enumerate(z):
        level = level + slope
        p00, p01, p11 = p00 + 2 * p01 + p11 + q, p01 + p11, p11 + q
        gain = p00 + r
        k0, k1 = p00 / gain, p01 / gain
        miss = obs - level
        level, slope = level + k0 * miss, slope + k1 * miss
        p00, p01, p11 = (1 - k0) * p00, (1 - k0) * p01, p11 - k1 * p01
        out[i], vel[i] = level, slope
    return out * span + low, vel * span


def _windows(x: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, n) if len(x) >= n else np.empty((0, n))


def _pad(values: np.ndarray, length: int) -> np.ndarray:
    return np.concatenate([np.full(length - len(values), np.nan), values])


def simple_returns(price: np.ndarray) -> np.ndarray:
    r = np.zeros(len(price))
    before = price[:-1]
    r[1:] = np.where(before != 0, price[1:] / np.where(before != 0, before, 1.0) - 1, 0.0)
    return r


def spectral_entropy(r: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """Entropy of the power at frequencies 0 .. n/2 - 1, over its maximum."""
    power = np.abs(np.fft.rfft(_windows(r, n), axis=1)[:, : n // 2]) ** 2
    total = power.sum(axis=1, keepdims=True)
    p = np.divide(power, total, out=np.zeros_like(power), where=total >= 1e-30)
    h = -np.where(p > 1e-30, p * np.log(np.where(p > 1e-30, p, 1.0)), 0.0).sum(axis=1) / math.log(n // 2)
    return _pad(np.where(total[:, 0] < 1e-30, np.nan, h), len(r))


def hurst(r: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """Slope of log rescaled range on log block size (8, 16, ... up to n / 2)."""
    w = _windows(r, n)
    sizes, logs = [], []
    size = 8
    while size <= n // 2:
        k = n // size
        b = w[:, : k * size].reshape(len(w), k, size)
        d = np.cumsum(b - b.mean(axis=2, keepdims=True), axis=2)
        sd = b.std(axis=2)
        rs = np.where(sd > 1e-15, (d.max(axis=2) - d.min(axis=2)) / np.where(sd > 1e-15, sd, 1.0), np.nan)
        count = np.isfinite(rs).sum(axis=1)
        mean = np.divide(np.nansum(rs, axis=1), count, out=np.full(len(w), np.nan), where=count > 0)
        logs.append(np.log(np.where(mean > 0, mean, np.nan)))
        sizes.append(math.log(size))
        size *= 2
    y, x = np.array(logs), np.array(sizes)[:, None]
    ok = np.isfinite(y)
    m = ok.sum(axis=0)
    x = np.where(ok, x, np.nan)
    with np.errstate(invalid="ignore", divide="ignore"):
        cx = x - np.nansum(x, axis=0) / m
        slope = np.nansum(cx * (y - np.nansum(np.where(ok, y, 0), axis=0) / m), axis=0) / np.nansum(cx * cx, axis=0)
    return _pad(np.where(m >= 2, slope, np.nan), len(r))


def acf_decay(r: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """Slope of log |autocorrelation| on log lag, lags 1 .. min(10, n / 4)."""
    w = _windows(r, n)
    d = w - w.mean(axis=1, keepdims=True)
    var = (d * d).mean(axis=1)
    lags = range(1, min(10, n // 4) + 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        acf = np.array([(d[:, k:] * d[:, :-k]).sum(axis=1) / (n * var) for k in lags])
        ok = (np.abs(acf) > 1e-15) & (var > 1e-30)
        y = np.where(ok, np.log(np.abs(np.where(ok, acf, 1.0))), np.nan)
        x = np.where(ok, np.log(np.array(lags))[:, None], np.nan)
        m = ok.sum(axis=0)
        cx = x - np.nansum(x, axis=0) / m
        slope = np.nansum(cx * y, axis=0) / np.nansum(cx * cx, axis=0)
    return _pad(np.where(m >= 2, slope, np.nan), len(r))


def turbulence(price: np.ndarray, least: int = 120, rounds: int = 100, tol: float = 1e-4) -> np.ndarray:
    """Smoothed probability of the wider of two Gaussian states, fitted by Baum-Welch on all returns."""
    return turbulences([price], least, rounds, tol)[0]


def turbulences(prices: list[np.ndarray], least: int = 120, rounds: int = 100, tol: float = 1e-4) -> list[np.ndarray]:
    """``turbulence`` of many series, each fitted on its own; a step in time is taken for many series at once."""
    out, fits = [np.full(len(p), np.nan) for p in prices], []
    for k, price in enumerate(prices):
        r = np.full(len(price), np.nan)
        r[1:] = np.divide(price[1:], price[:-1], out=np.full(max(len(price) - 1, 0), np.nan), where=price[:-1] != 0) - 1
        at = np.flatnonzero(np.isfinite(r))
        if len(at) >= least:
            fits.append((k, at, r[at]))
    fits.sort(key=lambda f: -len(f[2]))
    while fits:
        longest = len(fits[0][2])
        wide = max(1, SIDE_BY_SIDE // longest)
        now = [f for f in fits[:wide] if 2 * len(f[2]) > longest]  # shorter ones would mostly be padding
        fits = fits[len(now) :]
        for (k, at, _), p in zip(now, _baum_welch([f[2] for f in now], rounds, tol)):
            out[k][at] = p
            out[k] = pd.Series(out[k]).ffill().to_numpy()
    return out


def _baum_welch(series: list[np.ndarray], rounds: int, tol: float) -> list[np.ndarray]:
    """Probability of each series' wider state; series: longest first, a column each.  No column's result depends on the others."""
    found: list = [None] * len(series)
    # Two columns at least: numpy adds up a single one in another order.
    ids = np.arange(len(series)) if len(series) > 1 else np.zeros(2, int)
    size = np.array([len(x) for x in series])[ids]
    x = np.zeros((size[0], len(ids)))
    mu, sd = np.empty((2, len(ids))), np.empty((2, len(ids)))
    for c, i in enumerate(ids):
        x[: size[c], c] = series[i]
        half = np.array_split(np.sort(series[i]), 2)
        mu[:, c], sd[:, c] = [h.mean() for h in half], [max(h.std(), 1e-6) for h in half]
    pi, a, last = np.full((2, len(ids)), 0.5), np.full((2, 2, len(ids)), 0.5), np.full(len(ids), -np.inf)
    for k in range(rounds):
        with np.errstate(all="ignore"):
            gamma, pi, a, mu, sd, ll = _em_step(x, size, pi, a, mu, sd)
            done = (np.abs(ll - last) < tol) | (k == rounds - 1)
        last = ll
        for c in np.flatnonzero(done):
            if found[ids[c]] is None:
                found[ids[c]] = gamma[: size[c], int(np.argmax(sd[:, c])), c].copy()
        open_ = np.flatnonzero([found[i] is None for i in ids])
        if not len(open_):
            break
        if len(open_) <= 0.9 * len(ids) and len(ids) > 2:
            keep = open_ if len(open_) > 1 else open_[[0, 0]]
            ids, size, pi, a, mu, sd, last = ids[keep], size[keep], pi[:, keep], a[:, :, keep], mu[:, keep], sd[:, keep], last[keep]
            x = np.ascontiguousarray(x[: size[0], keep])
    return found


def _em_step(x: np.ndarray, size: np.ndarray, pi: np.ndarray, a: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> tuple:
    """State probabilities (time, state, column), new parameters, and the log-likelihood; x: time by column, zero from ``size`` on."""
    n, width = x.shape
    past = (np.arange(n)[:, None] >= size).astype(float) if size[-1] < n else None
    b = np.empty((n, 2, width))
    for s in range(2):
        z = (x - mu[s]) / sd[s]
        np.multiply(np.square(z, out=z), -0.5, out=z)
        b[:, s] = np.exp(z, out=z) / (sd[s] * math.sqrt(2 * math.pi)) + 1e-300
        if past is not None:
            b[:, s] *= 1 - past
    alpha, scale, both = np.empty((n, 2, width)), np.empty((n, width)), np.empty((2, 2, width))
    first, second, bs, al = both[0], both[1], list(b), list(alpha)
    one, two, rows, wide = list(alpha[:, 0]), list(alpha[:, 1]), list(scale), list(alpha[:, :, None])
    np.multiply(pi, bs[0], out=al[0])
    for t in range(n):
        if t:
            np.multiply(wide[t - 1], a, out=both)
            np.add(first, second, out=al[t])
            np.multiply(al[t], bs[t], out=al[t])
        np.add(one[t], two[t], out=rows[t])
        if past is not None:
            rows[t] += past[t]
        np.divide(al[t], rows[t], out=al[t])
    ends: dict[int, list[int]] = {}
    for c, m in enumerate(size):
        ends.setdefault(int(m) - 1, []).append(c)
    beta, v, u, moves = np.zeros((2, width)), np.empty((2, width)), np.empty((2, width)), np.zeros((2, 2, width))
    to_one, to_two = both[:, 0], both[:, 1]
    for t in range(n - 1, -1, -1):
        if t in ends:
            beta[:, ends[t]] = 1.0
        if t:
            np.multiply(bs[t], beta, out=v)
            np.divide(v, rows[t], out=u)
            np.multiply(wide[t - 1], u, out=both)
            moves += both
        np.multiply(al[t], beta, out=al[t])
        if t:
            np.multiply(a, v, out=both)
            np.add(to_one, to_two, out=beta)
            np.divide(beta, rows[t], out=beta)
    total = alpha[:, 0] + alpha[:, 1]
    if past is not None:
        total += past
    alpha /= total[:, None]
    moves *= a
    weight = np.maximum(alpha.sum(axis=0), 1e-300)
    mean = np.stack([(alpha[:, s] * x).sum(axis=0) for s in range(2)]) / weight
    var = np.stack([(alpha[:, s] * (x - mean[s]) ** 2).sum(axis=0) for s in range(2)]) / weight
    return alpha, alpha[0].copy(), moves / np.maximum(moves.sum(axis=1, keepdims=True), 1e-300), mean, np.maximum(np.sqrt(var), 1e-6), np.log(scale).sum(axis=0)


KERNELS = {
    "KF_VELOCITY": lambda p: kalman(p)[1],
    "KF_TREND_STRENGTH": lambda p: (lambda f, v: np.where(f != 0, v / np.where(f != 0, f, 1), np.nan))(*kalman(p)),
    "KF_NOISE_RATIO": lambda p: (lambda f, v: np.where(f != 0, np.abs(p - f) / np.abs(np.where(f != 0, f, 1)), np.nan))(*kalman(p)),
    "SPECTRAL_ENTROPY_60D": lambda p: spectral_entropy(simple_returns(p)),
    "HURST_60D": lambda p: hurst(simple_returns(p)),
    "ACF_DECAY_60D": lambda p: acf_decay(simple_returns(p)),
    "HMM_TURBULENCE_PROB": turbulence,
}


#: Kernels that take the series of many tickers at once.
BATCHED = {"HMM_TURBULENCE_PROB": turbulences}


def compute(panel: DataFrame, names: list[str], lag: int = 1) -> DataFrame:
    """date, ticker and the named kernel factors, lagged; rows come sorted by ticker, some whole tickers at a time."""
    import pyarrow as pa

    schema = "date date, ticker string, " + ", ".join(f"{n} double" for n in names)

    def starts(t: pa.Table) -> np.ndarray:
        codes = pd.factorize(t["ticker"].to_pandas())[0]
        return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])

    def values(t: pa.Table):
        series = np.split(np.array(t["close"].to_numpy(), dtype=float), starts(t)[1:])
        for n in names:
            done = BATCHED[n](series) if n in BATCHED else [KERNELS[n](p) for p in series]
            v = np.concatenate([np.concatenate([np.full(min(lag, len(v)), np.nan), v[: len(v) - lag]]) if lag else v for v in done])
            t = t.append_column(n, pa.array(v, pa.float64(), mask=~np.isfinite(v)))
        return t.drop_columns(["close"]).combine_chunks().to_batches(max_chunksize=50_000)

    def run(batches):
        held, rows, most = [], 0, ROWS
        for b in batches:
            held, rows = [*held, b], rows + b.num_rows
            if rows >= most:
                t = pa.Table.from_batches(held)
                cut = int(starts(t)[-1])
                if cut:
                    yield from values(t.slice(0, cut))
                held, rows = t.slice(cut).to_batches(), len(t) - cut
                most = max(ROWS, 2 * rows)
        if rows:
            yield from values(pa.Table.from_batches(held))

    spark = panel.sparkSession
    # So few parts that a call has many tickers, as far as the cores allow.
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(16, 4 * spark.sparkContext.defaultParallelism))
    d = panel.select("date", "ticker", F.col("close").cast("double").alias("close")).repartition(parts, "ticker")
    return d.sortWithinPartitions("ticker", F.asc_nulls_last("date")).mapInArrow(run, schema)
