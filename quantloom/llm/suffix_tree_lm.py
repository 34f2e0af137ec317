"""Language-model scoring with a probabilistic suffix tree.

Texts are read as lower-cased (A-Z) words, each followed by a blank, and one
end mark.  The tree's contexts are the last 0 to DEPTH bytes.  A context of two
bytes or more is kept if it occurs LEAST times or more in the training texts
and its next-byte distribution diverges from that of its parent (count times
Kullback-Leibler divergence of DIVERGENCE or more), or if a longer kept context
ends with it; those of no or one byte are kept if they occur LEAST times.  LEAST
is a fixed count, so more text gives a larger tree.  Distributions are smoothed
towards their parents' and the root's towards the uniform one.  The tree spells
each token (a word and its blank, or the end mark) with the probability of its
bytes given their longest kept suffixes; a text's score is the sum over its
tokens of log10(SHARE * frequency + (1 - SHARE) * spelling), where frequency is
the token's add-one frequency in the training texts.

The tree is a table, grown in parts by the last two bytes of contexts.  One of
TREE_ROWS rows at most is broadcast; with a larger one, the distinct bytes after
contexts are looked up part by part, summed to the distinct words after
contexts, and joined to the documents, with the same result.

The base score uses the frequencies alone.  Word counts are one table; words of
an N/WORDS-th of all N tokens (WORDS at most) are broadcast, all others are
joined by word.

Defined results: null text is empty (one end token); an empty training set
scores with uniform bytes and zero counts; repeated rows each return their
result; an empty table gives an empty result.  Texts of any length are
processed whole.  Only text and doc_id (which decides the split) are inputs.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .language_id import held_out

DEPTH, LEAST, DIVERGENCE, PULL = 5, 50, 8.0, 4.0
TREE_ROWS, PARTS = 4_000_000, 256
WORDS, SHARE = 500_000, 0.3  # the best of 0, 0.1, 0.3, 0.5, 0.7 and 0.9 on a seventh of the training rows of sf0.1
END = 10
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.frombuffer(common.LOWER_BYTES, np.uint8).copy()
_FOLD[_SPACE] = 32


def stream(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all documents of a buffer, and the end of each document in them."""
    docs = len(at) - 1
    b = np.insert(_FOLD[raw], np.repeat(at[1:], 2), np.tile(np.array([32, END], np.uint8), docs))
    before = np.concatenate([[END], b[:-1]])
    keep = (b != 32) | ((before != 32) & (before != END))
    b = b[keep]
    return b, np.flatnonzero(b == END) + 1


def contexts(b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The DEPTH symbols before each one (the last in the highest of DEPTH bytes); END, then zeros, stand before a document."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else np.zeros(0, np.int64)
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    key = np.zeros(len(b), np.uint64)
    for j in range(1, DEPTH + 1):
        sym = np.zeros(len(b), np.uint64)
        sym[j:] = b[: len(b) - j] if j <= len(b) else 0
        sym = np.where(place >= j, sym, np.where(place == j - 1, END, 0).astype(np.uint64))
        key |= sym << np.uint64(8 * (DEPTH - j))
    return key


def _unique(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        keys = np.sort(keys)
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[cut], np.diff(np.append(cut, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[cut], np.add.reduceat(n, cut)


def _blocks(raw: np.ndarray, at: np.ndarray):
    i, n = 0, len(at) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, side="right")) - 1))
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


class Tree:
    """Log-probabilities of symbols after contexts, from rows (d, ctx, s, v).

    v is the log10 probability of symbol s after the d bytes ctx, or with s -1 what is
    added to the parent's value for symbols not seen there.
    """

    SLOTS = 1 << 20

    def __init__(self, d: np.ndarray, ctx: np.ndarray, s: np.ndarray, v: np.ndarray):
        self.seen, self.unseen = [], []
        for depth in range(DEPTH + 1):
            for rows, found in ((self.seen, (d == depth) & (s >= 0)), (self.unseen, (d == depth) & (s < 0))):
                at = np.flatnonzero(found)
                key = ctx[at] << 8 | np.maximum(s[at], 0)
                order = np.argsort(key)
                rows.append((key[order].astype(np.int64), v[at][order].astype(np.float32)))

    def walk(self, grams: np.ndarray) -> np.ndarray:
        """log10 probabilities of distinct grams (context, then symbol)."""
        out, left = np.zeros(len(grams), np.float32), np.arange(len(grams))
        for d in range(DEPTH, -1, -1):
            g = grams[left]
            ctx = g >> (8 * (DEPTH + 1 - d)) << 8
            hit, v = _look(*self.seen[d], ctx | (g & 255))
            out[left[hit]] += v[hit]
            left, ctx = left[~hit], ctx[~hit]
            hit, v = _look(*self.unseen[d], ctx)
            out[left[hit]] += v[hit]
        out[left] -= math.log10(256)
        return out

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """Like walk, of grams in any order and number; values met lately are held."""
        if not hasattr(self, "held"):
            self.held = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, np.float32)
        keys, values = self.held
        at = _slot(grams)
        out, miss = values[at], np.flatnonzero(keys[at] != grams)
        if len(miss):
            new, back = np.unique(grams[miss], return_inverse=True)
            v = self.walk(new)
            out[miss] = v[back]
            at, first = np.unique(_slot(new), return_index=True)
            keys[at], values[at] = new[first], v[first]
        return out


def _slot(grams: np.ndarray) -> np.ndarray:
    return ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def _look(keys: np.ndarray, values: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(want), bool), np.zeros(len(want), np.float32)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return keys[at] == want, values[at]


def smooth(ctx: np.ndarray, s: np.ndarray, n: np.ndarray, up: np.ndarray) -> tuple:
    """Of counts of one depth in order of ctx: contexts, row of each count's context, probabilities, what unseen symbols are multiplied with, gains."""
    own, row = np.unique(ctx, return_inverse=True)
    total = np.bincount(row, weights=n, minlength=len(own))
    gain = np.bincount(row, weights=n * np.log(n / total[row] / up), minlength=len(own))
    return own, row, (n + PULL * up) / (total[row] + PULL), PULL / (total + PULL), gain


def trunk(d: np.ndarray, ctx: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list]:
    """Probabilities of symbols after each single byte, and the rows of the contexts of no and one byte."""
    root, after, rows = np.full(256, 1 / 256), np.zeros((256, 256)), []
    for depth in (0, 1):
        at = np.flatnonzero(d == depth)
        if not len(at):
            break
        c, x = ctx[at], s[at]
        own, row, p, less, _ = smooth(c, x, n[at], root[x])
        rows += [(np.full(len(at), depth), c, x, np.log10(p)), (np.full(len(own), depth), own, np.full(len(own), -1), np.log10(less))]
        if depth == 0:
            root = root * less[0]
            root[x] = p
        else:
            after[own] = less[:, None] * root
            after[c, x] = p
    return after, rows


def branch(after: np.ndarray, d: np.ndarray, ctx: np.ndarray, s: np.ndarray, n: np.ndarray) -> list:
    """Rows of the kept contexts among the counts of all contexts of two bytes or more that end alike."""
    levels, keys, probs = [], None, None
    for depth in range(2, DEPTH + 1):
        at = np.flatnonzero(d == depth)
        at = at[np.lexsort((s[at], ctx[at]))]
        c, x = ctx[at], s[at]
        # A parent has all the symbols of its longer contexts.
        up = after[c >> 8, x] if depth == 2 else probs[np.searchsorted(keys, c >> 8 << 8 | x)]
        own, row, p, less, gain = smooth(c, x, n[at], up)
        keys, probs = c << 8 | x, p
        levels.append([depth, c, x, p, own, row, less, gain >= DIVERGENCE])
    for upper, lower in zip(levels[-2::-1], levels[:0:-1]):
        upper[7][np.searchsorted(upper[4], lower[4][lower[7]] >> 8)] = True
    rows = []
    for depth, c, x, p, own, row, less, keep in levels:
        pick = keep[row]
        rows += [(np.full(pick.sum(), depth), c[pick], x[pick], np.log10(p[pick])), (np.full(keep.sum(), depth), own[keep], np.full(keep.sum(), -1), np.log10(less[keep]))]
    return rows


def _spread(rows: list) -> dict:
    if not rows:
        return {"d": np.zeros(0, int), "ctx": np.zeros(0, int), "s": np.zeros(0, int), "v": np.zeros(0)}
    return dict(zip(("d", "ctx", "s", "v"), (np.concatenate(x) for x in zip(*rows))))


def _arrays(rows, last: str = "v") -> tuple:
    """Columns d, ctx, s and another one, of a pandas frame or an Arrow table."""
    return tuple(np.asarray(rows[c]).astype(np.int64) for c in ("d", "ctx", "s")) + (np.asarray(rows[last]).astype(float),)


def part(ctx, d):
    """The part of the tree that a context of two bytes or more belongs to."""
    return F.pmod(F.xxhash64(F.expr(f"shiftright({ctx}, cast(8 * ({d} - 2) as int))")), F.lit(PARTS)).cast("int")


def count(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of grams (k, n) and of tokens (word, c) of the rows' texts; the end mark is a token."""
    common.small_batches(train.sparkSession)

    def run(batches):
        keys, n, held, words = [], [], 0, Counter()

        def merged():
            return _unique(np.concatenate(keys), np.concatenate(n))

        def rows(k, w, c):
            none = pa.nulls(len(c), pa.string() if w is None else pa.int64())
            for i in range(0, len(c), 100_000):
                own = pa.array(k[i : i + 100_000].view(np.int64)) if w is None else pa.array(w[i : i + 100_000], pa.binary()).cast(pa.string())
                both = (own, none[: len(own)]) if w is None else (none[: len(own)], own)
                yield pa.RecordBatch.from_arrays([*both, pa.array(c[i : i + 100_000], pa.int64())], names=["k", "word", "n"])

        for b in batches:
            raw, at = common.utf8_buffers(b.column("text"))
            for _, _, block, cut in _blocks(raw, at):
                s, ends = stream(block, cut)
                k, c = _unique(contexts(s, ends) << np.uint64(8) | s)
                keys.append(k)
                n.append(c)
                held += len(k)
                if held > 2_000_000:
                    k, c = merged()
                    keys, n, held = [k], [c], 0
                words.update(tokens(s))
                if len(words) > 1_000_000:
                    yield from rows(None, list(words), list(words.values()))
                    words.clear()
        if keys:
            k, c = merged()
            yield from rows(k, None, c)
        yield from rows(None, list(words), list(words.values()))

    both = train.select("text").mapInArrow(run, "k long, word string, n long").groupBy("k", "word").agg(F.sum("n").alias("n"))
    both = common.stored(both, "grams")
    return both.filter("word is null").select("k", "n"), both.filter("word is not null").select("word", F.col("n").alias("c"))


def tokens(s: np.ndarray) -> list[bytes]:
    """Tokens of a stream; the end mark is one."""
    return s.tobytes().replace(b"\n", b"\n ").split(b" ")[:-1]


def learn_tree(grams: DataFrame) -> DataFrame:
    """Rows (d, ctx, s, v, part) of the tree; part is -1 for contexts of no or one byte."""
    spark = grams.sparkSession
    kinds = F.array(*[F.struct(F.lit(d).alias("d"), F.shiftright("k", 8 * (DEPTH + 1 - d)).alias("ctx")) for d in range(DEPTH + 1)])
    rows = grams.select(F.explode(kinds).alias("x"), F.col("k").bitwiseAND(255).alias("s"), "n").groupBy("x.d", "x.ctx", "s").agg(F.sum("n").alias("n"))
    rows = rows.groupBy("d", "ctx").agg(F.collect_list(F.struct("s", "n")).alias("x"), F.sum("n").alias("t"))  # 256 symbols at most
    rows = rows.filter(F.col("t") >= LEAST).select("d", "ctx", F.inline("x"))
    rows = common.stored(rows, "contexts")
    after, low = trunk(*_arrays(rows.filter("d < 2").select("d", "ctx", "s", "n").orderBy("d", "ctx", "s").toArrow(), "n"))  # 257 x 256 rows at most
    after = spark.sparkContext.broadcast(after)
    high = rows.filter("d >= 2").withColumn("part", part("ctx", "d"))
    high = high.groupBy("part").applyInPandas(lambda key, x: pd.DataFrame(_spread(branch(after.value, *_arrays(x, "n")))).assign(part=key[0]), TREE)
    low = spark.createDataFrame(pd.DataFrame(_spread(low)).assign(part=-1), TREE)
    return common.stored(high.unionByName(low), "tree")


TREE = "d int, ctx long, s int, v double, part int"


def spelled(docs: DataFrame, tree: DataFrame) -> DataFrame:
    """Distinct words in context of each document (rid, doc_id, held_out, word, n, spell), with joins and no copy of the tree."""
    spark = docs.sparkSession
    common.small_batches(spark)

    def read(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            raw, at = common.utf8_buffers(b.column("text"))
            for i, j, block, cut in _blocks(raw, at):
                s, ends = stream(block, cut)
                mark = (s == 32) | (s == END)
                begin = np.flatnonzero(np.concatenate([[True], mark[:-1]]))
                doc = np.searchsorted(ends, begin, side="right")
                seen = Counter(zip(doc.tolist(), contexts(s, ends)[begin].tolist(), tokens(s)))
                place, ctx, words = zip(*seen)
                rid = row + np.array(place)
                row += j - i
                of = pa.array(i + np.array(place))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid), b.column("doc_id").take(of), b.column("held_out").take(of), pa.array(ctx), pa.array(words, pa.binary()).cast(pa.string()), pa.array(list(seen.values()))],
                    names=["rid", "doc_id", "held_out", "ctx", "word", "n"],
                )

    def bytes_of(batches):
        for b in batches:
            ctx, words = b.column("ctx").to_pylist(), b.column("word").cast(pa.binary()).to_pylist()
            out, mask = [], (1 << 8 * DEPTH) - 1
            for c, w in zip(ctx, words):
                at, own = c, []
                for x in w if w == b"\n" else w + b" ":
                    own.append(at << 8 | x)
                    at = (at >> 8 | x << 8 * (DEPTH - 1)) & mask
                out.append(own)
            yield pa.RecordBatch.from_arrays([b.column("ctx"), b.column("word"), pa.array(out, pa.list_(pa.int64()))], names=["ctx", "word", "k"])

    found = common.stored(docs.mapInArrow(read, "rid long, doc_id long, held_out boolean, ctx long, word string, n long"), "tokens")
    places = found.select("ctx", "word").distinct().mapInArrow(bytes_of, "ctx long, word string, k array<long>").select("ctx", "word", F.explode("k").alias("k"))
    places = places.groupBy("ctx", "word", "k").agg(F.count("*").alias("m"))
    low = _arrays(tree.filter("part < 0").select("d", "ctx", "s", "v").toArrow())
    low = spark.sparkContext.broadcast(low)

    def look(grams, rows):
        high = _arrays(rows)
        k = grams["k"].to_numpy(np.int64)
        return pd.DataFrame({"k": k, "v": Tree(*[np.concatenate(x) for x in zip(low.value, high)]).walk(k)})

    ask = places.select("k").distinct().withColumn("part", part("shiftright(k, 8)", str(DEPTH)))
    value = ask.groupBy("part").cogroup(tree.filter("part >= 0").groupBy("part")).applyInPandas(look, "k long, v double")
    spell = places.join(value, "k").groupBy("ctx", "word").agg(F.sum(F.col("m") * F.col("v")).alias("spell"))
    return found.join(spell, ["ctx", "word"]).select("rid", "doc_id", "held_out", "word", "n", "spell")


def score(docs: DataFrame, mod: int = 7, rest: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; learns from rows not held out."""
    spark = docs.sparkSession
    out = held_out(F.col("doc_id"), mod, rest)
    docs = common.id_text(docs)
    grams, counts = count(docs.filter(~out))
    docs = docs.withColumn("held_out", out)
    tree = learn_tree(grams)
    total, kinds = counts.agg(F.sum("c"), F.count("*")).first()
    total = total or 0
    norm = math.log10(total + 1 * (kinds + 1))
    freq = F.log10(F.coalesce("c", F.lit(0)) + 1.0) - norm
    mixed = F.log10(SHARE * F.pow(F.lit(10.0), freq) + (1 - SHARE) * F.pow(F.lit(10.0), F.greatest("spell", F.lit(-300.0))))
    if tree.count() > TREE_ROWS:
        rows = spelled(docs, tree).join(counts, "word", "left")
        known = F.col("n") * F.col("c").isNotNull().cast("long")
        rows = rows.select("rid", "doc_id", "held_out", F.col("n").alias("n_tokens"), known.alias("known"), (F.col("n") * freq).alias("base"), (F.col("n") * mixed).alias("score"))
    else:
        rows = _mapped(docs, Tree(*_arrays(tree.select("d", "ctx", "s", F.col("v").cast("float")).toArrow())), counts, total, norm)
        rows = rows.join(counts, "word", "left")
        rows = rows.withColumns({"known": F.coalesce("known", F.col("c").isNotNull().cast("long")), "base": F.coalesce("base", freq), "score": F.coalesce("score", mixed)})
    got = rows.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score"),
    )
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _mapped(docs: DataFrame, tree: Tree, counts: DataFrame, total: int, norm: float) -> DataFrame:
    """Sums of each document over its frequent words, and a row for each of its other words."""
    spark = docs.sparkSession
    common.small_batches(spark)
    frequent = counts.filter(F.col("c") >= max(1, total / WORDS)).toArrow()  # WORDS rows at most
    known = dict(zip(frequent["word"].cast(pa.binary()).to_pylist(), np.log10(np.asarray(frequent["c"]).astype(float) + 1).tolist()))
    held = spark.sparkContext.broadcast((tree, known))

    def run(batches):
        from pyspark import TaskContext

        tree, known = held.value
        row = TaskContext.get().partitionId() << 40
        none = lambda n, kind: pa.nulls(n, kind)
        for b in batches:
            raw, at = common.utf8_buffers(b.column("text"))
            for i, j, part, cut in _blocks(raw, at):
                s, ends = stream(part, cut)
                mark = (s == 32) | (s == END)
                begin = np.flatnonzero(np.concatenate([[True], mark[:-1]]))
                grams = (contexts(s, ends) << np.uint64(8) | s).view(np.int64)
                spell = np.add.reduceat(tree.log10(grams).astype(np.float64), begin)
                words = tokens(s)
                freq = np.array(list(map(known.get, words)), float)
                doc = np.searchsorted(ends, begin, side="right")
                rare = np.isnan(freq)
                ok = ~rare
                freq -= norm
                both = np.log10(SHARE * 10 ** freq[ok] + (1 - SHARE) * 10 ** np.maximum(spell[ok], -300))
                n = j - i
                sums = lambda x, pick: pa.array(np.bincount(doc[pick], weights=x, minlength=n).astype(float))
                left = np.flatnonzero(rare)
                ids = row + np.arange(n)
                row += n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids, ids[doc[left]]])),
                        pa.array([b" %d" % x for x in ids.tolist()] + [words[x] for x in left.tolist()], pa.binary()).cast(pa.string()),  # no word has a blank
                        pa.array(np.concatenate([np.zeros(n), spell[left]])),
                        pa.concat_arrays([b.column("doc_id").slice(i, n), none(len(left), pa.int64())]), pa.concat_arrays([b.column("held_out").slice(i, n), none(len(left), pa.bool_())]),
                        pa.concat_arrays([pa.array(np.bincount(doc, minlength=n)), none(len(left), pa.int64())]), pa.concat_arrays([pa.array(np.bincount(doc[ok], minlength=n)), none(len(left), pa.int64())]),
                        pa.concat_arrays([sums(freq[ok], ok), none(len(left), pa.float64())]), pa.concat_arrays([sums(both, ok), none(len(left), pa.float64())]),
                    ],
                    names=["rid", "word", "spell", "doc_id", "held_out", "n_tokens", "known", "base", "score"],
                )

    schema = "rid long, word string, spell double, doc_id long, held_out boolean, n_tokens long, known long, base double, score double"
    return docs.mapInArrow(run, schema)
