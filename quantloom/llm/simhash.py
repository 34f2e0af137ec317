"""SimHash near-duplicates by the generalised pigeonhole principle.

1.  Every text gets a 64-bit fingerprint; equal fingerprints are one row.
2.  Correlated bits are put into the same partition (correlations over all
    fingerprints).  Partitions get thresholds t_i in -1..limit with
    sum(t_i) = limit - parts + 1: two fingerprints within ``limit`` bits are
    then within t_i bits in some partition i (-1: the partition is not used).
    Dynamic programming picks the thresholds, and the number of partitions, of
    the least expected work: exact collision counts over all fingerprints for
    t = 0, carried on to larger t with the bits' own rates of difference.
3.  Fingerprints meet in buckets of equal partition values.  For t_i >= 1 each
    goes to the buckets of all values within t_i // 2 bits and probes those
    within the other half, rounded up: values within t_i bits share a bucket.
4.  A bucket is verified in blocks of BUCKET rows; a larger one is dealt out
    as pairs of blocks, so no task holds it whole and no pair is left out.  A
    block reports a spanning forest of its links, closest links first, which
    has the same connected components as the links themselves.
5.  Components by large-star and small-star steps (``components.py``).

Defined results: null text is empty; a text without words has fingerprint zero
and is linked like any other; an empty table gives an empty result; repeated
rows each return their result; null doc_ids are no candidate for component_id
unless a component has no other (then it is null).  Texts of any length are
processed whole.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE, LIMIT, BUCKET = 3, 3, 1024
#: Work of shuffling one row, in verified pairs.
ROW_COST = 300.0
ONE = np.uint64(1)
BLOCK_KEY = ["i", "v", "x", "y"]


def shingles(text: str | None, size: int) -> list[bytes]:
    """Space-joined runs of ``size`` lower-cased words, repeats included; fewer words: the whole sequence; none: none."""
    words = common.utf8(text).translate(common.LOWER_BYTES).split()
    if not words:
        return []
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= size:
        return [bytes(joined)]
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    return [joined[a:b] for a, b in zip(starts, ends[size - 1 :].tolist())]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    import xxhash

    return majority(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(text, size)], np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    if not len(h):
        return 0
    total = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, size) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return common.id_text(docs).mapInArrow(run, "doc_id long, fp long")


def bit_groups(fps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(64 x 64 correlations, rate of ones per bit) over all fingerprints; 64 x 64 sums leave the executors."""

    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            f = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(f, axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.float64)
            n += len(bits)
        i, j = np.nonzero(total)
        i, j, v = np.append(i, 64), np.append(j, 64), np.append(total[i, j], n)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(v)], names=["i", "j", "v"])

    got = fps.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    both, n = np.zeros((65, 65)), 0.0
    both[got["i"].to_numpy(int), got["j"].to_numpy(int)] = got["v"].to_numpy()
    n = max(both[64, 64], 1.0)
    both = both[:64, :64] / n
    p = np.diag(both).copy()
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return (both - np.outer(p, p)) / np.outer(spread, spread), p


def partitions(corr: np.ndarray, parts: int) -> list[list[int]]:
    """64 bits dealt to ``parts`` groups of even size; each group takes the bits most correlated with it."""
    left, groups = set(range(64)), []
    strength = np.abs(corr)
    for g in range(parts):
        size = (64 - 64 * g // parts) - (64 - 64 * (g + 1) // parts)
        first = max(left, key=lambda b: (strength[b, list(left)].sum(), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            best = max(left, key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def within(p: np.ndarray, collisions: float, t: int) -> float:
    """Expected pairs within t bits, from the pairs with none: elementary symmetric sums of the odds of a difference."""
    odds = 2 * p * (1 - p) / np.maximum(1 - 2 * p * (1 - p), 1e-9)
    e = np.zeros(t + 1)
    e[0] = 1.0
    for o in odds:
        e[1:] = e[1:] + o * e[:-1]
    return collisions * float(e.sum())


def allot(costs: list[list[float]], limit: int) -> tuple[float, list[int]]:
    """Thresholds in -1..limit of the least total cost whose sum is limit - parts + 1; costs[i][t + 1]."""
    parts = len(costs)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, ts) in best.items():
            for t in range(-1, limit + 1):
                to = (cost + c[t + 1], [*ts, t])
                if s + t not in nxt or to < nxt[s + t]:
                    nxt[s + t] = to
        best = nxt
    return best[limit - parts + 1]


def part_value(fp, bits: list[int]):
    """Column: the chosen bits of fp, in place."""
    return fp.bitwiseAND(int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64)))


def plan(fps: DataFrame, limit: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use."""
    corr, p = bit_groups(fps)
    # From so few parts that a probe ball stays small, to so many that each may need an exact match only.
    choices = [partitions(corr, m) for m in range(max(2, (limit + 4) // 4), limit + 2)]
    keys = [g for groups in choices for g in groups]
    values = F.array(*[F.struct(F.lit(i).alias("i"), part_value(F.col("fp"), g).alias("v")) for i, g in enumerate(keys)])
    n = F.count("*").cast("double")
    rows = fps.select(F.explode(values).alias("x")).groupBy("x.i", "x.v").agg(n.alias("n"))
    stats = {r["i"]: (r["n"], r["pairs"]) for r in rows.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).collect()}
    best = None
    at = 0
    for groups in choices:
        costs = []
        for g in groups:
            n, pairs = stats.get(at, (0.0, 0.0))
            at += 1
            ball = [sum(comb(len(g), k) for k in range((t + 1) // 2 + 1)) for t in range(limit + 1)]
            costs.append([0.0, *(ROW_COST * n * ball[t] + within(p[g], pairs, t // 2) * within(p[g], 1.0, (t + 1) // 2) for t in range(limit + 1))])
        got = allot(costs, limit)
        if best is None or got[0] < best[0]:
            best = (got[0], [(g, t) for g, t in zip(groups, got[1]) if t >= 0])
    return best[1]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def verify(left: np.ndarray, right: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks of fingerprints."""
    found_a, found_b, far = [], [], []
    step = max(1, (1 << 20) // max(1, len(right)))
    for i in range(0, len(left), step):
        apart = np.bitwise_count(left[i : i + step, None] ^ right[None, :])
        x, y = np.nonzero(apart <= limit)
        far.append(apart[x, y])
        found_a.append(left[i + x])
        found_b.append(right[y])
    if not found_a:
        return []
    order = np.argsort(np.concatenate(far), kind="stable")
    a, b = np.concatenate(found_a)[order], np.concatenate(found_b)[order]
    differ = a != b
    return _forest(a[differ].view(np.int64), b[differ].view(np.int64))


def _entry(i: int, value, probe: bool):
    return lambda m: F.struct(F.lit(i).alias("i"), value.bitwiseXOR(m).alias("v"), F.lit(probe).alias("probe"))


def deal(fps: DataFrame, limit: int, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """Rows (i, v, x, y, k, probe, fp, node) of the blocks x and y of buckets v of partitions i, block by block.

    fps: fp and node, one row a node; k is the row's own block.
    """
    kinds = []
    for i, (bits, t) in enumerate(chosen):
        value = part_value(F.col("fp"), bits)
        for probe, reach in ((False, range(t // 2 + 1)), (True, range(t // 2 + 1, (t + 1) // 2 + 1))):
            flips = [sum(1 << b for b in c) for k in reach for c in combinations(bits, k)]
            if flips:
                masks = F.array(*[F.lit(int(np.array(m, np.uint64).view(np.int64))) for m in flips])
                kinds.append(F.transform(masks, _entry(i, value, probe)))
    rows = fps.select("fp", "node", F.explode(F.concat(*kinds)).alias("x")).select("x.i", "x.v", "x.probe", "fp", "node")
    # Buckets of one row need nothing; larger ones are cut into blocks of BUCKET rows by a hash.
    sizes = rows.groupBy("i", "v").agg(F.count("*").alias("n"), F.count(F.when(~F.col("probe"), 1)).alias("own")).filter("n > 1 and own > 0")
    sizes = sizes.select("i", "v", F.ceil(F.col("n") / BUCKET).cast("int").alias("blocks"))
    rows = rows.join(sizes, ["i", "v"])
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("k", block)
    low, high = F.least("k", F.col("o")), F.greatest("k", F.col("o"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("i", "v", low.alias("x"), high.alias("y"), "k", "probe", "fp", "node")
    return by_block(rows)


def by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition(common.shuffle_parts(rows.sparkSession), *BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY)


def links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) within ``limit`` bits, enough to connect what is connected."""
    dealt = deal(fps.select("fp", F.col("fp").alias("node")), limit, plan(fps, limit)).drop("node")

    def run(batches):
        def done(own, probe):
            # own, probe: by block, 0 for x and 1 for y.
            out = []
            one = [np.array(o, np.int64).view(np.uint64) for o in own]
            two = [np.array(p, np.int64).view(np.uint64) for p in probe]
            if same:
                out += verify(one[0], one[0], limit) + verify(one[0], two[0], limit)
            else:
                out += verify(one[0], one[1], limit) + verify(one[0], two[1], limit) + verify(two[0], one[1], limit)
            return out

        key, own, probe, same, found = None, ([], []), ([], []), True, []
        for b in batches:
            for i, v, x, y, k, p, fp in zip(*(c.to_pylist() for c in b.columns)):
                if (i, v, x, y) != key:
                    if key is not None:
                        found += done(own, probe)
                    key, own, probe, same = (i, v, x, y), ([], []), ([], []), x == y
                (probe if p else own)[0 if k == x else 1].append(fp)
                if len(found) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])
                    found = []
        if key is not None:
            found += done(own, probe)
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row."""
    rows = common.cut(fingerprints(docs, size), "simhash")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(distinct.select("fp"), limit), "simhash")
    member = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    # A fingerprint's component, then each row's: both joins are on keys that repeat on one side only.
    member = member.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return rows.join(member, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
