import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import helpers

from quantloom.llm import token_files as tf

PATH = public_tokenizers.path(tf.TOKENIZER)


def test_code_is_optimal_and_limited():
    import heapq

    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 700):
        counts = rng.integers(1, 1000, n) ** 2
        bits = tf.code_lengths(counts, 16)
        assert bits.max() <= 16 and sum(2.0 ** -bits) <= 1
        bits = tf.code_lengths(counts, 40)
        heap, cost = sorted(counts.tolist()), 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a + b
            heapq.heappush(heap, a + b)
        if n > 1:
            assert int((counts * bits).sum()) == cost
    assert tf.code_lengths(2 ** np.arange(30), 8).max() == 8


def test_pack_round_trip():
    rng = np.random.default_rng(2)
    ids = rng.zipf(1.3, 5000) % 3000
    used, n = np.unique(ids, return_counts=True)
    bits = tf.code_lengths(n)
    word, length = np.zeros(3000, np.int64), np.zeros(3000, np.int64)
    word[used], length[used] = tf.canonical(used, bits), bits
    raw, marks = tf.pack(ids, word, length)
    limit = int(bits.max())
    order = np.lexsort((used, bits))
    table = np.repeat((used[order] * 64 + bits[order]).astype(np.uint32), np.left_shift(1, limit - bits[order]))
    table = np.concatenate([table, np.full((1 << limit) - len(table), 64, np.uint32)])
    assert (tf.unpack(raw, marks, len(ids), table, limit) == ids).all()


def test_odd_rows_match_the_library(spark, tmp_path):
    tf.write(tf.encode(helpers.odd(spark), PATH), str(tmp_path / "x"))
    got = tf.read(spark, str(tmp_path / "x")).collect()
    t = Tokenizer.from_file(PATH)
    rows = helpers.odd_rows() + []
    want = {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows}
    assert len(got) == len(rows)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and list(r.ids) == want[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))


def test_encoder_matches_the_library_on_mixed_text():
    import random

    t, r = Tokenizer.from_file(PATH), random.Random(3)
    signs = "aZs'tlvermd1 9!.,\n\t  \r é²½“—漢字ا\u0301😀_-'''ſ\u3000\u200b\x1c\x85\x0b\xa0"
    texts = ["  a  b\n\n c\t\td ", "don't we'll I'M 12.5€ ...", "日本語 text Ünï", "naïve x \r\n y", "<|endoftext|> a", "b<|endoftext|>", "", " ", "\n \n", "".join(map(chr, range(1, 0x250))), None]
    texts += ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    ids, n = tf.encoder(PATH)(pa.array(texts))
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]


def test_one_long_text_without_blanks():
    text = "abcdefghij" * 300_000
    ids, n = tf.encoder(PATH)(pa.array([text, "a b"]))
    assert ids.tolist() == [i for x in (text, "a b") for i in Tokenizer.from_file(PATH).encode(x, add_special_tokens=False).ids] and len(n) == 2


def test_table_matches_the_library(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tf.write(tf.encode(d, PATH), str(tmp_path / "x"))
    t, start = Tokenizer.from_file(PATH), 0
    got = {r.doc_id: r for r in tf.read(spark, str(tmp_path / "x")).collect()}
    for r in d.orderBy("doc_id").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        assert (got[r.doc_id].start, list(got[r.doc_id].ids)) == (start, ids)
        start += len(ids)


def test_empty_table(spark, tmp_path):
    tf.write(tf.encode(helpers.none(spark), PATH), str(tmp_path / "x"))
    assert tf.read(spark, str(tmp_path / "x")).collect() == []
