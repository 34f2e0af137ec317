"""Language identification by a multilingual mixture.

A document is a mixture of languages, each with its share.  Words are drawn
from byte trigram models learned from labelled texts; expectation-maximisation
estimates the shares from the words' likelihoods.  Sets of languages (the most
likely one, the two of the largest shares, ... up to all learned ones) compete
by log-likelihood less PENALTY times half the log of the number of words for
each language more.  The winner's languages and their shares are returned, the
largest share first; it is the prediction and its score.

Learning sums trigram counts on the executors: TABLE buckets a language leave
them at most.  Prediction works on whole batches of texts at a time.

Defined results: texts that are null or have no letter get ``und`` with score
0 and no languages; texts without a learned language (no training rows) too; equal shares go to
the language that comes first in sorted order; repeated rows each return their
result; an empty table gives an empty result.  Texts of any length are
processed whole.  Only text is an input; doc_id is passed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

TABLE, ROUNDS, PENALTY = 1 << 16, 8, 2.0
#: Bytes of text worked on at a time.
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.frombuffer(common.LOWER_BYTES, np.uint8)


def lower(raw: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the Latin-1 capitals (two-byte forms) lower-cased, white space as a blank."""
    b = _LOWER[raw]
    b[_SPACE[raw]] = 32
    after = np.zeros(len(b), bool)
    after[1:] = raw[:-1] == 0xC3
    capital = after & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
    b[capital] += 32
    return b


def trigrams(b: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that ends at each byte; a blank stands before the first."""
    x = np.concatenate([[32, 32], b]).astype(np.uint32)
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    return (h ^ (h >> np.uint32(15))) & np.uint32(TABLE - 1)


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == rest


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities TABLE x languages) from the rows' lang and text."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column("lang")
            for lang in langs.unique().to_pylist():
                pick = pa.compute.equal(langs, lang)
                raw, at = common.utf8_buffers(b.column("text").filter(pick))
                low = lower(raw)
                low = np.insert(low, at[1:-1], 32)
                got = np.bincount(trigrams(low), minlength=TABLE)
                sums[lang] = sums.get(lang, 0) + got
        for lang, got in sums.items():
            k = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(got[k])], names=["lang", "k", "n"])

    got = rows.mapInArrow(count, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique().tolist())
    counts = np.zeros((TABLE, len(langs)))
    where = {x: i for i, x in enumerate(langs)}
    counts[got["k"].to_numpy(int), [where[x] for x in got["lang"]]] = got["n"].to_numpy(float)
    seen = max(1, int((counts.sum(axis=1) > 0).sum()))
    return langs, np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * 4 * seen)).astype(np.float32)


def shares(word: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM shares (documents x languages) and log-likelihoods, with only the allowed languages.

    word: log-likelihood of each word under each language; first: the first word of each document.
    """
    n = np.diff(np.append(first, len(word)))
    doc = np.repeat(np.arange(len(first)), n)
    top = word.max(axis=1, keepdims=True)
    like = np.exp(word - top)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    share = share.astype(np.float32)
    for _ in range(ROUNDS):
        r = like * share[doc]
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
        share = np.add.reduceat(r, first, axis=0) / n[:, None].astype(np.float32)
    ll = np.log(np.maximum((like * share[doc]).sum(axis=1), 1e-30)) + top[:, 0]
    return share, np.add.reduceat(ll, first)


def predict_block(raw: np.ndarray, at: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index or -1, share of it, shares of all languages) of each document of a buffer."""
    docs = len(at) - 1
    best, score, mix = np.full(docs, -1), np.zeros(docs), np.zeros((docs, model.shape[1]), np.float32)
    low = np.insert(lower(raw), at[1:], 32)  # every word ends with a blank
    if not len(low) or not model.shape[1]:
        return best, score, mix
    gram = model[trigrams(low)]
    blank = low == 32
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(starts):
        return best, score, mix
    word = np.add.reduceat(gram, starts, axis=0)
    owner = np.searchsorted(at + np.arange(docs + 1), starts, side="right") - 1
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    who = owner[first]
    full, full_ll = shares(word, first, np.ones((len(who), model.shape[1]), np.float32))
    n = np.diff(np.append(first, len(word)))
    rank = np.argsort(-full, axis=1, kind="stable")
    cost = PENALTY * 0.5 * np.log(n + 1.0)
    single = np.add.reduceat(word, first, axis=0)
    pick = single.argmax(axis=1)
    value = single.max(axis=1).astype(np.float64)
    top = np.ones(len(who))
    chosen = np.zeros(full.shape, np.float32)
    chosen[np.arange(len(who)), pick] = 1.0
    for k in range(2, model.shape[1] + 1):
        allowed = np.zeros(full.shape, np.float32)
        np.put_along_axis(allowed, rank[:, :k], 1.0, axis=1)
        share, ll = shares(word, first, allowed) if k < model.shape[1] else (full, full_ll)
        better = ll - (k - 1) * cost > value
        value = np.where(better, ll - (k - 1) * cost, value)
        pick = np.where(better, share.argmax(axis=1), pick)
        top = np.where(better, share.max(axis=1), top)
        chosen = np.where(better[:, None], share, chosen)
    best[who], score[who], mix[who] = pick, top, chosen
    return best, score, mix


def _has_letter(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; texts without an ASCII one are looked at by character."""
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128)
    sums = np.concatenate([[0], np.cumsum(letter)])
    out = sums[at[1:]] > sums[at[:-1]]
    for i in np.flatnonzero(~out & (np.diff(at) > 0)):
        out[i] = any(c.isalpha() for c in raw[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score, languages and proportions of every row, and what other columns docs has besides text."""
    langs, table = model
    spark = docs.sparkSession
    common.small_batches(spark)
    held = spark.sparkContext.broadcast(table)  # TABLE x languages
    keep = [c for c in docs.columns if c != "text"]

    def run(batches):
        for b in batches:
            raw, at = common.utf8_buffers(b.column("text"))
            n = len(b)
            best, score, mix = np.full(n, -1), np.zeros(n), np.zeros((n, len(langs)), np.float32)
            i = 0
            while i < n:
                j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, side="right")) - 1)
                j = min(j, n)
                best[i:j], score[i:j], mix[i:j] = predict_block(raw[at[i] : at[j]], at[i : j + 1] - at[i], held.value)
                i = j
            best[~_has_letter(raw, at)] = -1
            names = [langs[k] if k >= 0 else "und" for k in best.tolist()]
            score = np.where(best >= 0, np.clip(score, 0.0, 1.0), 0.0)
            mix[best < 0] = 0
            order = np.argsort(-mix, axis=1, kind="stable")
            share = np.take_along_axis(mix, order, axis=1)
            has = share > 0
            offsets = pa.array(np.concatenate([[0], np.cumsum(has.sum(axis=1))]), pa.int32())
            some = pa.ListArray.from_arrays(offsets, pa.array([langs[k] for k in order[has].tolist()], pa.string()))
            parts = pa.ListArray.from_arrays(offsets, pa.array(share[has].astype(float)))
            cols = [*(b.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score.astype(float)), some, parts]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score", "languages", "proportions"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double, languages array<string>, proportions array<double>")
