import random
import sys

import public_tokenizers

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import helpers

from quantloom.llm import common, pieces

PATH = public_tokenizers.path(pieces.MODEL)


def every(lattice, word):
    """All (score, ids) of a word."""
    out = []

    def walk(end, score, ids):
        if end == 0:
            out.append((score, ids))
        else:
            for start, piece, s in lattice.edges(word, end):
                walk(start, score + s, (piece, *ids))

    walk(len(word), 0.0, ())
    return sorted(out, key=lambda x: -x[0])


def test_a_star_matches_brute_force():
    r = random.Random(0)
    table = {w.encode(): (i + 300, -float(r.randrange(1, 50))) for i, w in enumerate({"".join(r.choice("ab") for _ in range(r.randrange(1, 5))) for _ in range(20)})}
    lat = pieces.Lattice(table, list(range(256)))
    for _ in range(40):
        w = "".join(r.choice("abc") for _ in range(r.randrange(1, 9))).encode()
        want = every(lat, w)
        got = lat.a_star(w, lat.forward(w)[0], 6)
        assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in want[:6]]
        ahead, ids, second = lat.forward(w)
        assert (round(ahead[-1], 6), ids) in {(round(a, 6), b) for a, b in want} and (len(want) < 2 or round(second, 6) == round(want[1][0], 6))
        assert len(set(i for _, i in got)) == len(got) and all((round(s, 6), i) in {(round(a, 6), b) for a, b in want} for s, i in got)


def test_nbest_of_many_words_matches_all_combinations():
    r = random.Random(1)
    table = {w.encode(): (i + 300, -float(r.randrange(1, 90))) for i, w in enumerate({"".join(r.choice("ab") for _ in range(r.randrange(1, 4))) for _ in range(12)})}
    lat = pieces.Lattice(table, list(range(256)))
    for _ in range(20):
        words = ["".join(r.choice("ab") for _ in range(r.randrange(1, 5))).encode() for _ in range(4)]
        lat.learn(words)
        sums = [0.0]
        for w in words:
            sums = sorted((a + s for a in sums for s, _ in every(lat, w)), reverse=True)[:50]
        got = lat.nbest(words, 4)
        assert [round(s, 6) for s, _ in got] == [round(s, 6) for s in sums[:4]]


def test_round_trip_of_odd_texts():
    encode, decode = pieces.encoder(PATH)
    texts = [r[1] for r in helpers.odd_rows()] + ["▁", "a▁▁b ▁", "  two  blanks ", "日本語 \t\r\n x", "🙂 ok", "\x00\x01"]
    for t, got in zip(texts, encode(texts, 3)):
        for score, ids in got:
            assert decode(ids) == (t or "").encode()
        assert [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)


def test_operator(spark):
    got = pieces.encode(common.id_text(helpers.odd(spark)), PATH).collect()
    assert len(got) == len(helpers.odd_rows()) and all(r.round_trip for r in got)
    assert pieces.encode(common.id_text(helpers.none(spark)), PATH).collect() == []


def test_runs_of_blanks_use_their_pieces():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    full = {sp.id_to_piece(i).encode(): (i, sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    encode, decode = pieces.encoder(PATH)
    four = sp.piece_to_id("▁▁▁▁")
    assert four != sp.unk_id()
    lattice = pieces.Lattice(full, list(range(256)))
    for t in ("a    b", "  x", "if:\n    y  ", "   ", "a     b c"):
        got = encode([t], 4)[0]
        assert all(decode(ids) == t.encode() for _, ids in got) and len({tuple(ids) for _, ids in got}) == len(got)
        # One lattice over the whole text, cut nowhere.
        symbols = ("▁" + t.replace(" ", "▁")).encode()
        best = [{} for _ in range(len(symbols) + 1)]
        best[0] = {(): 0.0}
        for end in range(1, len(symbols) + 1):
            new = {}
            for start in range(end):
                if symbols[start:end] in full:
                    i, s = full[symbols[start:end]]
                    new |= {(*ids, i): c + s for ids, c in best[start].items()}
            if symbols[end - 1 : end] == b"\n":
                new |= {(*ids, sp.piece_to_id("<0x0A>")): c + lattice.byte for ids, c in best[end - 1].items()}
            best[end] = dict(sorted(new.items(), key=lambda x: -x[1])[:4])
        assert [s for s, _ in got] == sorted(best[-1].values(), reverse=True)
    assert len(encode(["a" + " " * 40_000 + "b"], 4)[0]) == 4


def test_words_side_by_side_match_one_by_one():
    r, lat = random.Random(5), pieces.Lattice(*pieces.load(PATH))
    words = [" " * r.randrange(0, 20) + "".join(r.choice("abdeinstößé日▁\n") for _ in range(r.randrange(1, 20))) for _ in range(400)]
    words = list({w.encode() for w in [*words, " ", "  ", " the", "x" * 300]})
    lat.learn(words)
    for w in words:
        best, ids, second = lat.forward(w)
        k = lat.slots[w]
        assert (lat.ids(k), lat.best[k]) == (ids, best[-1])
        assert lat.gap[k] == best[-1] - second


def test_table_matches_one_lattice_per_text(spark):
    lat = pieces.Lattice(*pieces.load(PATH))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in pieces.encode(common.id_text(docs), PATH).collect()}
    for r in docs.collect():
        if r.text:
            best, ids, _ = lat.forward(b" " + r.text.encode())
            assert list(got[r.doc_id].ids) == list(ids) and abs(got[r.doc_id].score - best[-1]) <= 1e-9 * abs(best[-1])
            assert got[r.doc_id].text == r.text and got[r.doc_id].round_trip
