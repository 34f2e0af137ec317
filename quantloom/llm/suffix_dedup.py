"""Suffix-array deduplication of repeated passages.

Every byte covered by a ``width``-byte string that also starts earlier (in a
smaller document, or earlier in the same one) is removed.

1.  Each window of ``width`` bytes is assigned to its minimiser, the smallest
    hash of its k-grams.  Equal windows have equal minimisers, so they meet in
    the same shard.  Neighbouring windows with one minimiser form a run.
2.  Runs whose minimiser occurs once cannot hold a repeated window and stop here.
3.  Runs of equal bytes are merged under their first occurrence (partial sums
    before the shuffle), so thousands of copies reach a shard as one run.
4.  A shard orders the suffixes of its runs by induced sorting whose queue
    spills to disk, but the shard itself must fit in memory (``induced.py``); suffixes whose common prefix reaches ``width`` are one
    window class, and all windows of a class but its first are repeats.
5.  The verdicts go back to their documents, where the removed bytes are cut.

Defined results: null text is empty; an empty table gives an empty result; a
null doc_id sorts first; rows repeating both doc_id and text are one document
and each returns its result; rows with one doc_id and different texts are
ordered by the text's 64-bit hash, which is part of their key.  Texts of any length are processed whole.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .induced import equal_windows

WIDTH, GRAM = 100, 20
#: Windows hashed at a time, and bytes of runs sorted at a time unless one minimiser has more.
BLOCK, SHARD_BYTES = 1 << 16, 4 << 20
#: Bytes that the queue of an induced sort holds in memory.
QUEUE_BYTES = 48 << 20

_rng = np.random.default_rng(20)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MULT = _rng.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
_LOW = np.uint64((1 << 18) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position; built by doubling."""
    powers, h, size, bit, done, out = [], _TABLE[raw], 1, 0, 0, None
    while True:
        if gram & size:
            powers.append((size, h))
        size *= 2
        if size > gram:
            break
        h = h[: len(h) - size // 2] * _MULT[bit] + h[size // 2 :]
        bit += 1
    n = len(raw) - gram + 1
    for size, h in reversed(powers):
        part = h[done : done + n]
        out = part.copy() if out is None else out * _MULT[7] + part
        done += size
    return _mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, m = 1, x
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def window_runs(raw: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser hash, first window, number of windows) of the runs of a buffer, windows over its whole length."""
    hs, starts, ends = [], [], []
    total = len(raw) - width + 1
    for a in range(0, total, BLOCK):
        n = min(BLOCK, total - a)
        h = gram_hashes(raw[a : a + n + width - 1], gram)
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        low = sliding_min(key, width - gram + 1)
        cut = np.flatnonzero(low[1:] != low[:-1]) + 1
        first = np.concatenate([[0], cut])
        hs.append(h[(low[first] & _LOW).astype(np.int64)])
        starts.append(first + a)
        ends.append(np.concatenate([cut, [n]]) + a)
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hs), start, np.concatenate(ends) - start


def _find_runs(width: int, gram: int):
    def runs(batches):
        for b in batches:
            raw, at = common.utf8_buffers(b.column("text"))
            h, start, n = window_runs(raw, width, gram)
            # Windows over the end of a document belong to none: cut runs at documents.
            doc = np.searchsorted(at, start, side="right") - 1
            pieces = []
            while len(start):
                stop = at[doc + 1] - width + 1
                upto = np.minimum(start + n, stop)
                ok = upto > start
                pieces.append((h[ok], doc[ok], (start - at[doc])[ok], (upto - start)[ok]))
                beyond = start + n > at[doc + 1]
                end = (start + n)[beyond]
                h, start, doc = h[beyond], at[doc[beyond] + 1], doc[beyond] + 1
                n = end - start
            if not pieces:
                continue
            h, doc, start, n = (np.concatenate(x) for x in zip(*pieces))
            pick = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), b.column("doc_id").take(pick), b.column("th").take(pick), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["h", "doc_id", "th", "start", "n"],
            )

    return runs


def _digest_runs(width: int):
    """A 128-bit digest of the bytes of each run."""
    import xxhash

    def digests(batches):
        for b in batches:
            raw, at = common.utf8_buffers(b.column("text"))
            view = memoryview(raw)
            runs = b.column("runs")
            flat = runs.flatten()
            sizes = np.diff(runs.offsets.to_numpy())
            doc = np.repeat(np.arange(len(b)), sizes)
            start, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            lo = (at[doc] + start).tolist()
            hi = (at[doc] + start + n + width - 1).tolist()
            d = b"".join([xxhash.xxh3_128_digest(view[x:y]) for x, y in zip(lo, hi)])
            d = np.frombuffer(d, np.int64).reshape(-1, 2)
            pick = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d[:, 0]), pa.array(d[:, 1]), b.column("doc_id").take(pick), b.column("th").take(pick), pa.array(start)],
                names=["c1", "c2", "doc_id", "th", "start"],
            )

    return digests


def _cut_runs(width: int):
    def contents(batches):
        for b in batches:
            raw, at = common.utf8_buffers(b.column("text"))
            view = memoryview(raw)
            runs = b.column("runs")
            flat = runs.flatten()
            doc = np.repeat(np.arange(len(b)), np.diff(runs.offsets.to_numpy()))
            start, n, h = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            # Of the document's runs, only those that are the first of their bytes.
            firsts = b.column("firsts")
            at_doc = np.repeat(np.arange(len(b)), np.diff(firsts.offsets.to_numpy()))
            first = np.isin((doc << 32) + start, (at_doc << 32) + firsts.flatten().to_numpy(zero_copy_only=False))
            doc, start, n, h = doc[first], start[first], n[first], h[first]
            lo, hi = (at[doc] + start).tolist(), (at[doc] + start + n + width - 1).tolist()
            pick = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), b.column("doc_id").take(pick), b.column("th").take(pick), pa.array(start), pa.array([bytes(view[x:y]) for x, y in zip(lo, hi)], pa.binary())],
                names=["h", "doc_id", "th", "start", "bytes"],
            )

    return contents


def later_windows(pieces: list[bytes], ids: list[tuple], starts: np.ndarray, width: int) -> list[list[int]]:
    """For each piece, the windows (as a, b, a, b, ... of half-open ranges) that an earlier window equals.

    ids order the documents of the pieces; starts are the pieces' places in them.
    """
    sizes = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    text = raw.astype(np.uint16) + np.uint16(1)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text[begin + sizes] = 0
    n = sizes - width + 1
    piece = np.repeat(np.arange(len(pieces)), n)
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    classes = equal_windows(text, begin[piece] + offset, width, QUEUE_BYTES)
    rank = {x: i for i, x in enumerate(sorted(set(ids), key=lambda x: (x[0] is not None, x[0] or 0, x[1])))}
    doc = np.array([rank[x] for x in ids], np.int64)
    place = (doc[piece] << np.int64(32)) + starts[piece] + offset
    first = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, classes, place)
    later = first[classes] < place
    edge = np.flatnonzero(np.diff(np.concatenate([[0], later.view(np.int8), [0]])) | np.isin(np.arange(len(later) + 1), np.cumsum(n)[:-1]))
    out: list[list[int]] = [[] for _ in pieces]
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if later[a]:
            out[piece[a]] += [int(offset[a]), int(offset[a]) + b - a]
    return out


def _sort_shards(width: int):
    def shards(batches):
        held, ids, starts, size, last = [], [], [], 0, None

        def flush():
            spans = later_windows(held, ids, np.array(starts, np.int64), width)
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int64()), pa.array(starts, pa.int32()), pa.array(spans, pa.list_(pa.int32()))],
                names=["doc_id", "th", "start", "later"],
            )

        for b in batches:
            for h, d, t, s, x in zip(*(b.column(i).to_pylist() for i in range(5))):
                if size > SHARD_BYTES and h != last:
                    yield flush()
                    held, ids, starts, size = [], [], [], 0
                held.append(x)
                ids.append((d, t))
                starts.append(s)
                size, last = size + len(x), h
        if held:
            yield flush()

    return shards


def _apply(width: int, with_text: bool):
    def cut(batches):
        for b in batches:
            raw, at = common.utf8_buffers(b.column("text"))
            view, rows = memoryview(raw), []
            for i, (runs, firsts) in enumerate(zip(b.column("runs").to_pylist(), b.column("firsts").to_pylist())):
                lo, n = int(at[i]), int(at[i + 1] - at[i])
                spans, first = [], {x["start"]: x["later"] for x in firsts or ()}
                for x in runs or ():
                    later = first.get(x["start"])
                    s = x["start"]
                    spans += [(s, s + x["n"] + width - 1)] if later is None else [(s + p, s + q + width - 1) for p, q in zip(later[::2], later[1::2])]
                spans.sort()
                merged: list[list[int]] = []
                for p, q in spans:
                    if merged and p <= merged[-1][1]:
                        merged[-1][1] = max(q, merged[-1][1])
                    else:
                        merged.append([p, q])
                kept, p = [], 0
                for x, y in merged:
                    kept.append(view[lo + p : lo + x])
                    p = y
                kept.append(view[lo + p : lo + n])
                rest = b"".join(kept)
                rows.append((n, n - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest))
            cols = list(zip(*rows)) or [()] * 5
            out = [b.column("doc_id"), b.column("th"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
            names = ["doc_id", "th", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:  # a character of which some bytes went goes altogether
                out.append(pa.array([x.decode("utf-8", "ignore") for x in cols[4]], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return cut


def text_key(text):
    """Column: the text's 64-bit hash, which tells rows of one doc_id apart."""
    return F.xxhash64(text)


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, th (the text's 64-bit hash), n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept_text.

    See the module for the rules and the results of odd input.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    d = common.id_text(docs).withColumn("th", text_key(F.col("text")))
    runs = d.mapInArrow(_find_runs(width, gram), "h long, doc_id long, th long, start int, n int")
    again = runs.groupBy("h").count().filter("count > 1").select("h")
    runs = runs.join(again, "h", "left_semi")
    runs = common.stored(runs.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n", "h")).alias("runs")), "runs")

    def with_docs(other: DataFrame, how: str, base: DataFrame = d) -> DataFrame:
        o = other.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), other.columns[-1]).hint("shuffle_hash")
        return base.join(o, base["doc_id"].eqNullSafe(o["_d"]) & base["th"].eqNullSafe(o["_t"]), how).drop("_d", "_t")

    digests = with_docs(runs, "inner").mapInArrow(_digest_runs(width), "c1 long, c2 long, doc_id long, th long, start int")
    firsts = digests.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "th", "start")).alias("f")).select("f.*")
    firsts = firsts.groupBy("doc_id", "th").agg(F.collect_set("start").alias("firsts"))
    contents = with_docs(firsts, "inner", with_docs(runs, "inner")).mapInArrow(_cut_runs(width), "h long, doc_id long, th long, start int, bytes binary")
    shards = contents.repartition(common.shuffle_parts(spark), "h").sortWithinPartitions("h")
    spans = shards.mapInArrow(_sort_shards(width), "doc_id long, th long, start int, later array<int>")
    spans = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "later")).alias("firsts"))
    out = with_docs(spans, "left", with_docs(runs, "left"))
    schema = "doc_id long, th long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return out.mapInArrow(_apply(width, with_text), schema + ", kept_text string" * with_text)
