"""Token ids in compact files: canonical length-limited Huffman coding.

``encode`` turns texts into ids.  ``write`` counts all ids of the table, builds
one canonical code whose words have at most LIMIT bits, and writes the ids in
doc_id order.  ``read`` decodes them with one table look-up per id.

Layout below ``path`` (written and read with Spark, so any store will do):

- ``code/``   (id, bits): code lengths; the canonical code follows from them.
- ``blocks/`` one row per independent block: ``shard`` and ``block`` (their
  order), ``before`` (ids of the shard before the block), ``doc_id`` and
  ``n_ids`` (the documents), ``marks`` (bit offset of every MARK-th id) and
  ``bits`` (the coded ids).  A block holds whole documents, BLOCK ids or more.

A reader starts at any mark; all stretches of a block are decoded side by side.

Defined results: null text is empty and gives only the end id; rows repeating a
doc_id are all kept, ordered by their ids; a null doc_id comes first; an empty
table gives an empty file.  Texts of any length are encoded whole.  Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
BLOCK, MARK, LIMIT = 1 << 19, 256, 16
#: Pieces of text whose ids a worker process keeps, and bytes of text that are split at a time.
CACHE, STEP = 500_000, 4 << 20
#: Kinds of characters that the split of byte-level vocabularies tells apart.
BLANK, LETTER, NUMBER, OTHER, UNKNOWN, NONE = range(6)
_ENCODERS: dict[str, "Encoder"] = {}


def byte_symbols() -> str:
    """The character that stands for each byte in byte-level vocabularies (fixed by them)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(rest)) for b in range(256))


class Encoder:
    """Ids of texts, as the tokenizers library gives them.

    A byte-level vocabulary encodes the pieces of its split pattern one by one.
    Texts are split with numpy, equal pieces are found by Arrow, the library's
    model turns each new piece into ids, and a worker process keeps them.  The
    library's own split says which kind each character is.  Texts that hold an
    added token (as <|endoftext|>), and all texts of other kinds of tokenizer,
    go to the library whole.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, model = spec["pre_tokenizer"] or {}, spec["model"]
        self.by_piece = (
            (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True)
            and spec["normalizer"] is None
            and model["type"] == "BPE"
            and not (model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("dropout") or model.get("ignore_merges"))
        )
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.symbols = dict(enumerate(byte_symbols()))
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        if hasattr(self.whole.model, "_resize_cache"):
            self.whole.model._resize_cache(0)  # every piece is passed to the model once
        self.forget()

    def forget(self) -> None:
        self.slots, self.flat, self.ends = {}, array("I"), array("q", [0])

    def kind(self, c: str) -> int:
        """The kind of a character: what it is not split from."""
        split = self.whole.pre_tokenizer.pre_tokenize_str
        return next((k for k, near in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(near + c)) == 1), BLANK)

    def starts(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Byte offsets at which the pieces of the texts raw[at[i]:at[i + 1]] begin."""
        n = len(raw)
        if n == 0:
            return np.zeros(0, np.int64)
        if raw.max() < 128:
            code, place, first = raw, None, at[:-1]
        else:
            code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
            place = np.flatnonzero((raw & 0xC0) != 0x80)
            first = np.searchsorted(place, at[:-1])
        kind = self.kinds[code]
        if (kind == UNKNOWN).any():
            for c in np.unique(code[kind == UNKNOWN]).tolist():
                self.kinds[c] = self.kind(chr(c))
            kind = self.kinds[code]
        size = len(kind)
        fresh = np.zeros(size, bool)
        fresh[first[first < size]] = True
        before = np.empty_like(kind)
        before[0], before[1:] = NONE, kind[:-1]
        before[fresh] = NONE
        start = kind != before
        # The last blank of a run goes to what follows it, or stands alone if it is not a space.
        w = np.flatnonzero(start & (before == BLANK))
        start[w - 1] = True
        start[w] = code[w - 1] != 32
        # 's 'd 'm 't 'll 've 're are pieces of their own.
        q = np.flatnonzero((code == 39) & start)
        for length, ends in ((1, ("s", "d", "m", "t")), (2, ("ll", "ve", "re"))):
            p = q[q + length < size]
            for k in range(1, length + 1):
                p = p[~fresh[p + k]]
            hit = np.zeros(len(p), bool)
            for e in ends:
                hit |= np.logical_and.reduce([code[p + k + 1] == ord(c) for k, c in enumerate(e)])
            p = p[hit]
            start[p + 1] = False
            p = p[p + length + 1 < size] + length + 1
            start[p[kind[p] == LETTER]] = True
        found = np.flatnonzero(start)
        return found if place is None else place[found]

    def learn(self, pieces: list[bytes]) -> None:
        """Keep the ids of new pieces."""
        model, slots, flat, ends = self.whole.model, self.slots, self.flat, self.ends
        symbols, at = b"".join(pieces).decode("latin-1").translate(self.symbols), 0
        for p in pieces:
            slots[p] = len(slots)
            flat.extend([t.id for t in model.tokenize(symbols[at : at + len(p)])])
            ends.append(len(flat))
            at += len(p)

    def split_ids(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts raw[at[i]:at[i + 1]], and the number of ids of each."""
        if len(self.slots) > CACHE:
            self.forget()
        begin = self.starts(raw, at)
        counts = np.diff(np.searchsorted(begin, at))
        cuts = np.append(begin, len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(cuts), pa.py_buffer(raw)]).dictionary_encode()
        own = pieces.dictionary.to_pylist()
        self.learn([p for p in own if p not in self.slots])
        slot = np.fromiter(map(self.slots.__getitem__, own), np.int64, len(own))[pieces.indices.to_numpy()]
        flat, end = np.array(self.flat, np.uint32), np.array(self.ends, np.int64)
        size = end[slot + 1] - end[slot]
        total = np.cumsum(size)
        ids = flat[np.repeat(end[slot] - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        edges = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(edges)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none), and the number of ids of each."""
        whole = np.full(len(texts), not self.by_piece)
        for token in self.added:
            whole |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        if whole.any():
            got = [e.ids for e in self.whole.encode_batch_fast([t or "" for t in texts.filter(pa.array(whole)).to_pylist()], add_special_tokens=False)]
            texts = pc.if_else(pa.array(whole), pa.scalar("", texts.type), texts)
        raw, at = common.utf8_buffers(texts)
        row, out, counts = 0, [], []
        while row < len(texts):
            stop = max(row + 1, int(np.searchsorted(at, at[row] + STEP, side="right")) - 1)
            ids, n = self.split_ids(raw[at[row] : at[stop]], at[row : stop + 1] - at[row])
            out.append(ids)
            counts.append(n)
            row = stop
        ids, n = (np.concatenate(out), np.concatenate(counts)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if whole.any():
            where, sizes = np.cumsum(n)[whole], [len(g) for g in got]
            ids = np.insert(ids, np.repeat(where, sizes), np.array([i for g in got for i in g], np.uint32))
            n[whole] = sizes
        return ids, n


def encoder(path: str) -> Encoder:
    """The encoder that this worker process keeps for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, and low and high: the halves of the ids as little-endian 16-bit integers, end id included (high: null if all are 0)."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        work = encoder(path)
        for b in batches:
            ids, n = work(b.column("text"))
            ends = np.cumsum(n)
            ids = np.insert(ids, ends, end_id)
            wide = ids.astype("<u4").view("<u2").reshape(-1, 2)
            # Two columns of halves: the high one is nearly always 0 and costs nothing on disk.
            cut = [0, *(ends + np.arange(1, len(n) + 1)).tolist()]
            low, high = wide[:, 0].tobytes(), wide[:, 1]
            out = [low[2 * x : 2 * y] for x, y in zip(cut, cut[1:])]
            top = [high[x:y].tobytes() if high[x:y].any() else None for x, y in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary()), pa.array(top, pa.binary())], names=["doc_id", "low", "high"])

    return common.id_text(docs).mapInArrow(run, "doc_id long, low binary, high binary")


def _ids(low: bytes, high: bytes | None) -> np.ndarray:
    ids = np.frombuffer(low, "<u2").astype(np.uint32)
    return ids if high is None else ids | np.frombuffer(high, "<u2").astype(np.uint32) << np.uint32(16)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for symbols with these counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.float64)
    levels, packed = [], np.zeros(0)
    for _ in range(limit):
        weight = np.concatenate([leaf, packed])
        by = np.argsort(weight, kind="stable")
        levels.append(by)
        weight = weight[by]
        pairs = len(weight) // 2
        packed = weight[: 2 * pairs].reshape(-1, 2).sum(axis=1)
    take, bits = 2 * n - 2, np.zeros(n, np.int64)
    for by in reversed(levels):
        chosen = by[:take]
        leaves = chosen[chosen < n]
        bits[leaves] += 1
        take = 2 * (len(chosen) - len(leaves))
    out = np.empty(n, np.int64)
    out[order] = bits
    return out


def canonical(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Code words: ascending by (length, id)."""
    order = np.lexsort((ids, bits))
    b = bits[order]
    step = np.left_shift(1, int(b.max(initial=0)) - b)
    words = np.empty(len(ids), np.int64)
    words[order] = (np.cumsum(step) - step) >> (int(b.max(initial=0)) - b)
    return words


def pack(ids: np.ndarray, word: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Coded ids, and the bit offset of every MARK-th; word and bits are indexed by id."""
    size = bits[ids]
    at = np.cumsum(size) - size
    byte = at >> 3
    value = word[ids] << (32 - size - (at & 7))
    length = (int(at[-1] + size[-1]) + 7) // 8 if len(ids) else 0
    sums = np.bincount(byte, weights=value, minlength=length + 4).astype(np.int64)
    out = np.zeros(len(sums) + 4, np.uint8)
    for k in range(4):
        out[k : k + len(sums)] += ((sums >> (24 - 8 * k)) & 255).astype(np.uint8)
    return out[:length].tobytes(), at[::MARK]


def unpack(raw: bytes, marks: np.ndarray, count: int, table: np.ndarray, limit: int) -> np.ndarray:
    """The ids of a block: at each step one id of every stretch. table: id * 64 + length for each prefix of limit bits."""
    b = np.frombuffer(raw + b"\0" * 8, np.uint8).astype(np.uint32)
    four = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    at, out = marks.astype(np.int64), np.empty((MARK, len(marks)), np.uint32)
    last = 8 * len(raw)
    for k in range(MARK):
        found = table[(four[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - limit)]
        out[k] = found >> 6
        at = np.minimum(at + (found & 63), last)
    return out.T.reshape(-1)[:count]


def write(ids: DataFrame, path: str) -> None:
    """Write encoded documents (``encode``) below path, in ascending doc_id order."""
    spark = ids.sparkSession
    ids.write.option("compression", "zstd").parquet(f"{path}/ids")
    ids = spark.read.parquet(f"{path}/ids")

    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for low, high in zip(b.column("low"), b.column("high")):
                got = np.bincount(_ids(low.as_py(), high.as_py()))
                if len(got) > len(total):
                    total = np.pad(total, (0, len(got) - len(total)))
                total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counted = ids.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    used, n = counted["id"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)  # as many as the vocabulary has
    bits = code_lengths(n)
    spark.createDataFrame([(int(i), int(b)) for i, b in zip(used, bits)], "id long, bits int").coalesce(1).write.parquet(f"{path}/code")
    size = int(used.max(initial=0)) + 1
    words, lengths = np.zeros(size, np.int64), np.zeros(size, np.int64)
    words[used], lengths[used] = canonical(used, bits), bits
    code = spark.sparkContext.broadcast((words, lengths))

    def blocks(batches):
        from pyspark import TaskContext

        word, bits = code.value
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        held, docs, held_n = [], [], 0

        def flush():
            nonlocal block, before, held, docs, held_n
            all_ids = np.concatenate(held)
            raw, marks = pack(all_ids, word, bits)
            row = pa.RecordBatch.from_pylist(
                [{"shard": shard, "block": block, "before": before, "doc_id": docs, "n_ids": [len(x) for x in held], "marks": marks.tolist(), "bits": raw}],
                schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("bits", pa.binary())]),
            )
            block, before, held, docs, held_n = block + 1, before + held_n, [], [], 0
            return row

        for b in batches:
            for d, low, high in zip(b.column("doc_id").to_pylist(), b.column("low"), b.column("high")):
                x = _ids(low.as_py(), high.as_py())
                held.append(x)
                docs.append(d)
                held_n += len(x)
                if held_n >= BLOCK:
                    yield flush()
        if held:
            yield flush()

    parts = common.shuffle_parts(spark)
    placed = ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "low")
    placed.mapInArrow(blocks, "shard int, block int, before long, doc_id array<long>, n_ids array<long>, marks array<long>, bits binary").write.option("compression", "none").parquet(f"{path}/blocks")
    _remove(spark, f"{path}/ids")


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids."""
    pairs = spark.read.parquet(f"{path}/code").orderBy("id").toPandas()
    used, bits = pairs["id"].to_numpy(np.int64), pairs["bits"].to_numpy(np.int64)
    limit = max(1, int(bits.max(initial=1)))
    order = np.lexsort((used, bits))
    table = np.repeat((used[order] * 64 + bits[order]).astype(np.uint32), np.left_shift(1, limit - bits[order]))
    table = np.concatenate([table, np.full((1 << limit) - len(table), 64, np.uint32)])
    code = spark.sparkContext.broadcast(table)
    stored = spark.read.parquet(f"{path}/blocks")
    totals = stored.select("shard", F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()
    start, base = 0, {}  # a row for each file
    for r in totals:
        base[r["shard"]] = start
        start += r["n"]

    def decode(batches):
        table = code.value
        for b in batches:
            for r in b.to_pylist():
                n = np.array(r["n_ids"], np.int64)
                ends = np.cumsum(n)
                ids = unpack(r["bits"], np.array(r["marks"]), int(ends[-1]), table, limit).astype("<u4")
                raw = ids.tobytes()
                at = [0, *ends.tolist()]
                parts = [raw[4 * x : 4 * y] for x, y in zip(at, at[1:])]
                cols = [
                    pa.array(r["doc_id"], pa.int64()), pa.array(ends - n + r["before"] + base[r["shard"]]),
                    pa.array(n), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(p, "<u4").astype(np.int64) for p in parts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    common.small_batches(spark)
    return stored.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
