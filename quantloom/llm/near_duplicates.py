"""Near-duplicate groups of which one document stays.

Texts with one set of five-word shingles are one node.  Its fingerprint has
WORDS times 64 SimHash bits of that set (repeats do not count).  A generalised
pigeonhole search as in ``simhash.py`` finds candidates, but for a similarity in
place of a number of bits: two sets of a Jaccard similarity of SIMILARITY differ
in about 15 % of the bits, too many for partitions that must not miss a pair.
So the thresholds (-1: a partition is not used) are those of the least expected
work with which a pair of just that similarity shares a bucket with a
probability of RECALL; closer pairs do with more.  Partitions are groups of
correlated bits, and dynamic programming finds the thresholds.

A candidate link counts if the two texts' shingle sets have a Jaccard similarity
of SIMILARITY or more.  A first pass over the buckets finds the members of
candidate links, and a second one gets their texts, tests the links and reports
a spanning forest of those that pass: only a link between texts that passed
links already join is not tested.  A link is tested in the first partition in
which its ends meet.  Large buckets are dealt out in pairs of blocks.

Defined results: texts without words are copies of each other; rows repeating
doc_id and text are one document and go or stay together; a null doc_id counts
as the smallest; an empty table gives an empty result.  All columns are kept.
"""

from __future__ import annotations

from itertools import combinations
from math import acos, comb, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .simhash import BLOCK_KEY, BUCKET, ROW_COST, by_block, partitions, shingles, within

SHINGLE, SIMILARITY, RECALL, WORDS = 5, 0.8, 0.98, 8
FP = [f"f{w}" for w in range(WORDS)]
#: A partition in use: the 64-bit word it is cut from, its bits and its threshold.
Part = tuple[int, list[int], int]
NOTHING = np.zeros(0, np.int64)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    import xxhash

    return np.unique(np.array([xxhash.xxh3_64_intdigest(s) for s in shingles(text, size)], np.uint64))


def fingerprint(x: np.ndarray) -> np.ndarray:
    """WORDS 64-bit words: each bit is set if more than half of the set's hashes have it."""
    total = np.zeros(64 * WORDS, np.int64)
    for a in range(0, len(x), 2040):
        h = x[a : a + 2040, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
        bits = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        # Sums of up to 255 rows fit in a byte.
        total += np.add.reduceat(bits, np.arange(0, len(h), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(x), bitorder="little").view(np.uint64)


def marks(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Node (a hash of the whole set) and fingerprint of a text's shingle set."""
    import xxhash

    x = shingle_set(text, size)
    return np.append(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())), fingerprint(x))


def bit_counts(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(correlations of the bits of each word, rate of ones of each bit, number of nodes), over all nodes."""

    def run(batches):
        total, n = np.zeros((WORDS, 64, 64)), 0
        for b in batches:
            for w in range(WORDS):
                f = b.column(w).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(f, axis=1, bitorder="little").astype(np.float32)
                total[w] += bits.T @ bits
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*range(WORDS), WORDS], pa.int32()), pa.array([*(t.ravel() for t in total), np.array([float(n)])], pa.list_(pa.float64()))], names=["w", "v"])

    rows = nodes.select(*FP).mapInArrow(run, "w int, v array<double>").select("w", F.posexplode("v").alias("i", "v"))
    got = rows.groupBy("w", "i").agg(F.sum("v").alias("v")).toPandas()  # WORDS * 64 * 64 sums and a count
    both, n = np.zeros((WORDS, 4096)), 0
    for w, part in got.groupby("w"):
        if w < WORDS:
            both[w, part["i"].to_numpy(int)] = part["v"].to_numpy()
        else:
            n = int(part["v"].sum())
    both = both.reshape(WORDS, 64, 64) / max(n, 1)
    p = np.array([np.diag(x) for x in both])
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return (both - p[:, :, None] * p[:, None, :]) / (spread[:, :, None] * spread[:, None, :]), p, n


def allot(costs: list[list[float]], gains: list[list[float]], need: float, unit: float = 0.01) -> tuple[float, list[int]] | None:
    """Thresholds from -1 up of the least total cost whose gains reach ``need`` together; costs[i][t + 1], gains[i][t + 1]."""
    goal = int(np.ceil(need / unit))
    best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for cost, gain in zip(costs, gains):
        nxt: dict[int, tuple[float, tuple]] = {}
        for have, (c, ts) in best.items():
            for t, (more, g) in enumerate(zip(cost, gain)):
                at, to = min(goal, have + int(g / unit)), (c + more, (*ts, t - 1))
                if at not in nxt or to < nxt[at]:
                    nxt[at] = to
        best = nxt
    return (best[goal][0], list(best[goal][1])) if goal in best else None


def plan(nodes: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> list[Part]:
    """The partitions in use, for candidates among all nodes."""
    corr, rate, n = bit_counts(nodes)
    # Two sets of one size with this Jaccard similarity; of sets of other sizes fewer bits differ.
    differ = acos(min(1.0, 2 * similarity / (1 + similarity))) / pi
    best = None
    for each in (3, 4, 5):
        parts = [(w, bits) for w in range(WORDS) for bits in partitions(corr[w], each)]
        costs, gains = [], []
        for w, bits in parts:
            p = rate[w][bits]
            equal = n * (n - 1) / 2 * float(np.prod(p * p + (1 - p) ** 2))
            ball = [sum(comb(len(bits), k) for k in range((t + 1) // 2 + 1)) for t in range(3)]
            costs.append([0.0, *(ROW_COST * n * ball[t] + within(p, equal, t // 2) * within(p, 1.0, (t + 1) // 2) for t in range(3))])
            near = np.cumsum([comb(len(bits), k) * differ**k * (1 - differ) ** (len(bits) - k) for k in range(3)])
            gains.append([0.0, *(-np.log1p(-near))])
        got = allot(costs, gains, -log(1 - recall))
        if got is not None and (best is None or got[0] < best[0]):
            best = (got[0], [(w, bits, t) for (w, bits), t in zip(parts, got[1]) if t >= 0])
    return best[1]


def _long(bits) -> int:
    return int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64))


def _entry(i: int, value: Column, probe: bool):
    return lambda m: F.struct(F.lit(i).alias("i"), value.bitwiseXOR(m).alias("v"), F.lit(probe).alias("probe"))


def deal(nodes: DataFrame, chosen: list[Part]) -> DataFrame:
    """Rows (i, v, x, y, k, probe, node, FP) of the blocks x and y of buckets v of partitions i, block by block.

    k is the row's own block.  Only buckets of more than BUCKET rows have more than one.
    """
    kinds = []
    for i, (w, bits, t) in enumerate(chosen):
        value = F.col(FP[w]).bitwiseAND(_long(bits))
        for probe, reach in ((False, range(t // 2 + 1)), (True, range(t // 2 + 1, (t + 1) // 2 + 1))):
            flips = [c for k in reach for c in combinations(bits, k)]
            if flips:
                kinds.append(F.transform(F.array(*[F.lit(_long(c)) for c in flips]), _entry(i, value, probe)))
    rows = nodes.select("node", *FP, F.explode(F.concat(*kinds)).alias("x")).select("x.i", "x.v", "x.probe", "node", *FP)
    large = rows.groupBy("i", "v").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET)
    # Written first: Spark then knows how few they are before it joins them.
    large = common.stored(large.select("i", "v", F.ceil(F.col("n") / BUCKET).cast("int").alias("blocks")), "large-buckets")
    rows = rows.join(large, ["i", "v"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("k", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return by_block(rows.select("i", "v", F.least("k", "o").alias("x"), F.greatest("k", "o").alias("y"), "k", "probe", "node", *FP))


def blocks(batches):
    """(key, columns after it) of the blocks of two rows and more in batches that are sorted by BLOCK_KEY."""
    held: list = []
    for b in batches:
        held.append(b)
        table = pa.Table.from_batches(held).combine_chunks()
        keys = [table.column(j).to_numpy() for j in range(4)]
        if not len(keys[0]):
            continue
        new = np.flatnonzero(np.logical_or.reduce([np.diff(k) != 0 for k in keys])) + 1
        at = np.concatenate([[0], new])
        yield from _cut(table, keys, at[:-1], at[1:])
        held = table.slice(int(at[-1])).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from _cut(table, [table.column(j).to_numpy() for j in range(4)], np.array([0]), np.array([len(table)]))


def _cut(table: pa.Table, keys: list[np.ndarray], starts: np.ndarray, ends: np.ndarray):
    own = [c.to_numpy() if not pa.types.is_string(c.type) else c.combine_chunks() for c in table.columns[4:]]
    for a, b in zip(starts.tolist(), ends.tolist()):
        if b - a > 1:
            yield tuple(int(k[a]) for k in keys), [c[a:b] for c in own]


def candidates(key: tuple, k: np.ndarray, probe: np.ndarray, fp: np.ndarray, chosen: list[Part], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two ends of a block's links within limit that no earlier partition has, closest links first.

    fp: one row of words a node.
    """
    i, _, x, y = key
    own, low = ~probe, k == x
    left = np.flatnonzero(low)
    right = left if x == y else np.flatnonzero(~low)
    step, found = max(1, (1 << 18) // max(1, len(right))), []
    for s in range(0, len(left), step):
        part = left[s : s + step]
        apart = np.zeros((len(part), len(right)), np.uint16)
        for w in range(fp.shape[1]):
            apart += np.bitwise_count(fp[part, None, w] ^ fp[None, right, w])
        ok = (apart <= limit) & (own[part, None] | own[None, right])
        if x == y:
            ok &= part[:, None] < right[None, :]
        a, b = np.nonzero(ok)
        if not len(a):
            continue
        differ = fp[part[a]] ^ fp[right[b]]
        new = np.ones(len(a), bool)
        for w, bits, t in chosen[:i]:
            new &= np.bitwise_count(differ[:, w] & np.uint64(sum(1 << j for j in bits))) > t
        a, b = a[new], b[new]
        found.append(np.array([part[a], right[b], apart[a, b]], np.int64))
    if not found:
        return NOTHING, NOTHING
    a, b, apart = np.concatenate(found, axis=1)
    order = np.argsort(apart, kind="stable")
    return a[order], b[order]


def furthest(similarity: float) -> int:
    """Bits in which sets of this similarity differ at most, but for less than one pair in ten thousand."""
    n, p = 64 * WORDS, acos(min(1.0, 2 * similarity / (1 + similarity))) / pi
    return int(np.ceil(n * p + 4 * np.sqrt(n * p * (1 - p))))


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    n = int((both[1:] == both[:-1]).sum())
    return n >= similarity * (len(both) - n)


def tested_forest(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links (a, b) whose sets are similar enough."""
    size = np.array([len(s) for s in sets])
    fit = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])
    a, b = a[fit], b[fit]
    root, out, step = list(range(len(sets))), [], 1024

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    while len(a):
        for x, y in zip(a[:step].tolist(), b[:step].tolist()):
            rx, ry = find(x), find(y)
            if rx != ry and similar(sets[x], sets[y], similarity):
                root[max(rx, ry)] = min(rx, ry)
                out.append((x, y))
        label = np.array([find(x) for x in range(len(sets))])
        a, b = a[step:], b[step:]
        apart = label[a] != label[b]
        a, b, step = a[apart], b[apart], 2 * step
    return out


def _matrix(columns: list[np.ndarray]) -> np.ndarray:
    return np.stack(columns, axis=1).view(np.uint64)


def members(nodes: DataFrame, chosen: list[Part], limit: int) -> DataFrame:
    """BLOCK_KEY, k, probe, node and FP of the rows of each block that are an end of a candidate link."""

    def run(batches):
        for key, (k, probe, node, *fp) in blocks(batches):
            a, b = candidates(key, k, probe, _matrix(fp), chosen, limit)
            if len(a):
                at = np.unique(np.concatenate([a, b]))
                cols = [pa.array([v] * len(at), kind) for v, kind in zip(key, (pa.int32(), pa.int64(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c[at]) for c in (k, probe, node, *fp))], names=[*BLOCK_KEY, "k", "probe", "node", *FP])

    words = ", ".join(f"{f} long" for f in FP)
    return deal(nodes, chosen).mapInArrow(run, f"i int, v long, x int, y int, k int, probe boolean, node long, {words}")


def tested_links(found: DataFrame, texts: DataFrame, chosen: list[Part], limit: int, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links of nodes, enough to connect what links of similar texts (node, text) connect."""

    def run(batches):
        for key, (k, probe, node, *fp, text) in blocks(batches):
            a, b = candidates(key, k, probe, _matrix(fp), chosen, limit)
            out = tested_forest(a, b, [shingle_set(t, size) for t in text.to_pylist()], similarity)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([node[p[i]] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    rows = found.join(texts, "node").select(*BLOCK_KEY, "k", "probe", "node", *FP, "text")
    return by_block(rows).mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, th (hash of the text) and root (a long that the rows of a group share) of every row."""
    common.small_batches(docs.sparkSession)
    d = common.id_text(docs).withColumn("th", F.xxhash64("text"))

    def run(batches):
        for b in batches:
            at = np.array([marks(t, size) for t in b.column("text").to_pylist()], np.uint64).view(np.int64).reshape(-1, 1 + WORDS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), *(pa.array(c) for c in at.T.copy())], names=["doc_id", "th", "node", *FP])

    words = ", ".join(f"{f} long" for f in FP)
    rows = common.stored(d.mapInArrow(run, f"doc_id long, th long, node long, {words}"), "fingerprints")
    first = common.stored(rows.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("f"), *[F.first(f).alias(f) for f in FP]), "nodes")
    nodes = first.select("node", *FP)
    chosen, limit = plan(nodes, similarity, recall), furthest(similarity)
    found = common.stored(members(nodes, chosen, limit), "candidates")
    heads = first.join(found.select("node").distinct(), "node").select("node", F.col("f.doc_id").alias("_d"), F.col("f.th").alias("_t"))
    texts = d.join(heads, d["doc_id"].eqNullSafe(F.col("_d")) & (d["th"] == F.col("_t"))).select("node", "text").dropDuplicates(["node"])
    links = common.stored(tested_links(found, texts, chosen, limit, size, similarity), "links")
    near = components(links, "near")
    return rows.select("doc_id", "th", "node").join(near, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """docs without all but the smallest doc_id of each group."""
    best = groups(docs, size, similarity, recall).groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("f"))
    best = best.select(F.struct(F.col("f.doc_id"), F.col("f.th")).alias("_best"))
    # The row goes along as one value, for its columns may have any names.
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    key = F.struct(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("th")).alias("_key")
    return docs.select(row, key).join(best, F.col("_key").eqNullSafe(F.col("_best")), "left_semi").select("_row.*")
