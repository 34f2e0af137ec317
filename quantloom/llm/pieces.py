"""SentencePiece encoding and decoding with N-best segmentations.

The pieces and scores come from a SentencePiece model file.  A text is turned
into symbols as such models expect (a blank becomes the mark U+2581, one mark
stands in front) and segmented over the lattice of pieces.  A forward Viterbi
pass gives every position the best score of a path to it.  Those scores are an
exact heuristic for an A* search from the end back to the start, so the search
takes paths off its queue in order of their score and the first N that arrive
are the N best.

No piece holds a mark after another symbol (``load`` makes sure), so the lattice
of a text falls into those of its words, each with the run of blanks before it
(pieces of several blanks included), and a worker process segments each new word
once, the words of a batch side by side.  The forward pass also gives the score of a word's second-best path.  A path among the N best of
a text leaves the best path in the N - 1 words at most whose second-best
segmentation costs least; A* runs over the lattices of those.

Defined results: null text is empty and has no pieces; white space other than
the blank, a literal U+2581 and characters without a piece become byte pieces;
decoding gives back every text exactly (in the operator's text column null stays null); equal scores prefer the longer last
piece; repeated rows each return their result; an empty table gives an empty
result.  Texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

MODEL, BEST = "piece_bpe_32k.model", 4
MARK = "▁"
#: Words whose segmentation a worker process keeps, and bytes of text that are split at a time.
CACHE, STEP = 400_000, 4 << 20
#: Longer words (in bytes) are segmented one by one, others in groups of this many.
LONG, GROUP = 64, 1 << 14
RESULTS = ["n_pieces", "ids_crc32", "score", "nbest_scores", "nbest_crc32s", "round_trip", "ids"]
_ENCODERS: dict[str, "Lattice"] = {}


def load(path: str) -> tuple[dict[bytes, tuple[int, float]], list[int], list[bytes]]:
    """(piece bytes, a blank for the mark, to (id, score), ids of the 256 byte pieces, bytes of every id)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    table, single, back = {}, [0] * 256, [b""] * sp.get_piece_size()
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            single[int(piece[3:5], 16)] = i
            back[i] = bytes([int(piece[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {i} has a mark after another symbol: texts do not fall into words")
            back[i] = piece.replace(MARK, " ").encode()
            table[back[i]] = (i, sp.get_score(i))
    return table, single, back


class Trie:
    """The pieces as a trie whose steps are looked up for many words at once: a hash table of (node, byte)."""

    def __init__(self, table: dict[bytes, tuple[int, float]]):
        nodes = {b"": 0}
        for p in table:
            for i in range(1, len(p) + 1):
                nodes.setdefault(p[:i], len(nodes))
        self.id, self.score = np.full(len(nodes), -1, np.int64), np.zeros(len(nodes))
        for p, (i, s) in table.items():
            self.id[nodes[p]], self.score[nodes[p]] = i, s
        step = np.array([nodes[p[:-1]] << 8 | p[-1] for p in nodes if p], np.int64)
        self.bits = max(4, (2 * len(nodes)).bit_length())
        self.keys, self.child = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        left, at = np.arange(len(step)), self.place(step)
        while len(left):
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] == -1]
            self.keys[at[first]], self.child[at[first]] = step[left[first]], left[first] + 1
            keep = np.ones(len(left), bool)
            keep[first] = False
            left, at = left[keep], (at[keep] + 1) & ((1 << self.bits) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes one byte further, -1 where no piece begins so."""
        keys = node << 8 | byte
        at = self.place(keys)
        out = np.where(self.keys[at] == keys, self.child[at], -1)
        left = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            here = self.keys[at[left]]
            hit = here == keys[left]
            out[left[hit]] = self.child[at[left[hit]]]
            left = left[~hit & (here != -1)]
        return out


class Lattice:
    """Best segmentations of words over a table of pieces."""

    def __init__(self, table: dict[bytes, tuple[int, float]], single: list[int], back: list[bytes] | None = None):
        self.table, self.single, self.back = table, single, back
        self.longest = max(map(len, table), default=1)
        # Pieces, and an empty entry for every other start of one: no longer piece begins where it is missing.
        self.starts: dict[bytes, tuple] = {p[:i]: () for p in table for i in range(1, len(p))} | table
        # A byte piece costs more than any whole path of pieces of the model could.
        self.byte = min((s for _, s in table.values()), default=0.0) * 2 - 1.0
        self.trie = Trie(table)
        self.forget()

    def forget(self) -> None:
        self.slots: dict[bytes, int] = {}  # of each known word: its ids, their score, what the second-best path costs more
        self.flat, self.ends, self.best, self.gap = array("I"), array("q", [0]), array("d"), array("d")
        self.ways: dict[tuple[bytes, int], list] = {}

    @staticmethod
    def marked(word: bytes) -> int:
        """Blanks at the start of a word, which must not become byte pieces."""
        return len(word) - len(word.lstrip(b" "))

    def edges(self, word: bytes, end: int, marked: int | None = None):
        """(start, id, score) of the pieces that end at ``end``, longest first."""
        marked = self.marked(word) if marked is None else marked
        for start in range(max(0, end - self.longest), end):
            got = self.table.get(word[start:end])
            if got is not None:
                yield start, got[0], got[1]
        if end > marked:
            yield end - 1, self.single[word[end - 1]], self.byte

    def forward(self, word: bytes) -> tuple[list[float], tuple[int, ...], float]:
        """Viterbi scores of all positions of a word, the best ids, and the score of the second-best path."""
        n, longest, get = len(word), self.longest, self.starts.get
        best, second, back = [-np.inf] * (n + 1), [-np.inf] * (n + 1), [(0, 0)] * (n + 1)
        best[0], marked = 0.0, self.marked(word)
        for a in range(n):
            one, two, b = best[a], second[a], a
            for b in range(a + 1, min(n, a + longest) + 1):
                got = get(word[a:b])
                if got is None:
                    break
                if got:
                    c = one + got[1]
                    if c > best[b]:
                        second[b] = max(best[b], two + got[1])
                        best[b], back[b] = c, (a, got[0])
                    elif c > second[b]:
                        second[b] = c
            if a < marked:
                continue
            b, c = a + 1, one + self.byte
            if c > best[b]:
                second[b] = max(best[b], two + self.byte)
                best[b], back[b] = c, (a, self.single[word[a]])
            elif c > second[b]:
                second[b] = c
        ids, at = [], n
        while at:
            at, piece = back[at]
            ids.append(piece)
        return best, tuple(ids[::-1]), second[n]

    def a_star(self, word: bytes, ahead: list[float], n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of a word, from its end back; ahead: its forward Viterbi scores."""
        # Of equal scores the path nearest its end goes first: long runs of blanks have very many equal paths.
        queue, out, tick, marked = [(-ahead[-1], len(word), 0, 0.0, None)], [], 0, self.marked(word)
        while queue and len(out) < n:
            _, at, _, done, path = heapq.heappop(queue)
            if at == 0:
                ids = []
                while path is not None:
                    piece, path = path
                    ids.append(piece)
                out.append((done, tuple(ids)))
                continue
            for start, piece, score in self.edges(word, at, marked):
                tick += 1
                heapq.heappush(queue, (-(ahead[start] + score + done), start, tick, done + score, (piece, path)))
        return out

    def _group(self, words: list[bytes]) -> None:
        """Forward passes of words in order of their length, place by place for all of them."""
        n, size = len(words), np.array([len(w) for w in words])
        width = int(size[-1])
        text = np.zeros((n, width), np.uint8)
        text[np.arange(width)[None, :] < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        marked = (text == 32).cumprod(axis=1).sum(axis=1)
        best, second = np.full((n, width + 1), -np.inf), np.full((n, width + 1), -np.inf)
        start, piece = np.zeros((n, width + 1), np.int64), np.zeros((n, width + 1), np.int64)
        best[:, 0], single = 0.0, np.array(self.single, np.int64)

        def reach(r, a, b, score, ids):
            c, two, old = best[r, a] + score, second[r, a] + score, best[r, b]
            up = c > old
            second[r, b] = np.where(up, np.maximum(old, two), np.maximum(second[r, b], c))
            r = r[up]
            best[r, b], start[r, b], piece[r, b] = c[up], a, ids[up]

        for a in range(width):
            rows = np.arange(np.searchsorted(size, a, side="right"), n)
            live, node = rows, np.zeros(len(rows), np.int64)
            for b in range(a + 1, width + 1):
                fits = size[live] >= b
                live, node = live[fits], node[fits]
                node = self.trie.step(node, text[live, b - 1].astype(np.int64))
                found = node >= 0
                live, node = live[found], node[found]
                if not len(live):
                    break
                whole = self.trie.id[node] >= 0
                reach(live[whole], a, b, self.trie.score[node[whole]], self.trie.id[node[whole]])
            rows = rows[marked[rows] <= a]
            reach(rows, a, a + 1, self.byte, single[text[rows, a]])
        at, steps, ids = size.copy(), np.zeros(n, np.int64), np.zeros((n, width), np.int64)
        while len(r := np.flatnonzero(at)):
            ids[r, width - 1 - steps[r]] = piece[r, at[r]]
            at[r] = start[r, at[r]]
            steps[r] += 1
        rows = np.arange(n)
        top = best[rows, size]
        with np.errstate(invalid="ignore"):
            self._keep(words, ids[np.arange(width)[None, :] >= width - steps[:, None]], steps, top, top - second[rows, size])

    def _keep(self, words, ids, counts, best, gap) -> None:
        for w in words:
            self.slots[w] = len(self.slots)
        self.ends.frombytes((self.ends[-1] + np.cumsum(counts)).astype(np.int64).tobytes())
        self.flat.frombytes(np.asarray(ids, np.uint32).tobytes())
        self.best.frombytes(np.asarray(best, np.float64).tobytes())
        self.gap.frombytes(np.asarray(gap, np.float64).tobytes())

    def learn(self, words: list[bytes]) -> None:
        """Segment new words: best ids, their score, and what the second-best segmentation costs more."""
        new = sorted({w for w in words if w not in self.slots}, key=len)
        long = next((i for i, w in enumerate(new) if len(w) > LONG), len(new))
        for i in range(0, long, GROUP):
            self._group(new[i : min(long, i + GROUP)])
        for w in new[long:]:
            best, ids, second = self.forward(w)
            self._keep([w], ids, [len(ids)], [best[-1]], [best[-1] - second])

    def ids(self, slot: int) -> tuple[int, ...]:
        return tuple(self.flat[self.ends[slot] : self.ends[slot + 1]])

    def paths(self, words, slots: np.ndarray, gap: np.ndarray, best: np.ndarray, n: int) -> list[tuple[float, tuple]]:
        """The n best segmentations of a sequence of known words: score, and (place, ids) of the words that leave their best path.

        words: the word of each place; slots, gap and best: what is known of it.
        """
        total = float(best.sum())
        if n <= 1 or not len(slots):
            return [(total, ())]
        k = min(n - 1, len(slots))
        edge = np.partition(gap, k - 1)[k - 1]
        weak = np.flatnonzero(gap <= edge)
        weak = weak[np.argsort(gap[weak], kind="stable")][:k]
        found = [(0.0, ())]  # cost over the best
        for i in weak.tolist():
            word, own = words[i], self.ids(int(slots[i]))
            if (word, n) not in self.ways:
                ways = self.a_star(word, self.forward(word)[0], n)
                # Among equal scores the path already taken comes first.
                self.ways[word, n] = [(float(best[i]), own), *[w for w in ways if w[1] != own]][:n]
            ways = self.ways[word, n]
            found = heapq.nsmallest(n, ((c + ways[0][0] - s, (*p, (i, w)) if j else p) for c, p in found for j, (s, w) in enumerate(ways)), key=lambda x: x[0])
        return [(total - cost, changed) for cost, changed in found]

    def nbest(self, words: list[bytes], n: int) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a sequence of words."""
        self.learn(words)
        slots = np.array([self.slots[w] for w in words], np.int64)
        got = self.paths(words, slots, np.array(self.gap)[slots], np.array(self.best)[slots], n)
        return [(score, [x for i, k in enumerate(slots.tolist()) for x in dict(changed).get(i) or self.ids(k)]) for score, changed in got]

    def segment(self, texts: pa.Array, n: int):
        """Of each text: the ids of its best segmentation, where each word's begin, and the n best paths (``paths``)."""
        raw, at = common.utf8_buffers(texts)
        row = 0
        while row < len(texts):
            stop = max(row + 1, int(np.searchsorted(at, at[row] + STEP, side="right")) - 1)
            yield from self._segment(raw[at[row] : at[stop]], at[row : stop + 1] - at[row], n)
            row = stop

    def _segment(self, raw: np.ndarray, at: np.ndarray, n: int):
        if len(self.slots) > CACHE:
            self.forget()
        # A blank stands in front of every text that is not empty; a word starts where a run of blanks does.
        some = np.diff(at) > 0
        raw = np.insert(raw, at[:-1][some], 32)
        at = at + np.concatenate([[0], np.cumsum(some)])
        blank = raw == 32
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        begin[at[:-1][some]] = True
        begin = np.flatnonzero(begin)
        edge = np.searchsorted(begin, at)
        cuts = np.append(begin, len(raw)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(cuts), pa.py_buffer(raw)]).dictionary_encode()
        own = words.dictionary.to_pylist()
        self.learn(own)
        index = words.indices.to_numpy()
        slots = np.fromiter(map(self.slots.__getitem__, own), np.int64, len(own))[index]
        flat, ends, best, gap = np.array(self.flat, np.uint32), np.array(self.ends), np.array(self.best)[slots], np.array(self.gap)[slots]
        size = ends[slots + 1] - ends[slots]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(ends[slots] - total[:-1], size) + np.arange(total[-1])]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            got = self.paths(_Words(own, index[a:b]), slots[a:b], gap[a:b], best[a:b], n)
            yield ids[total[a] : total[b]], total[a : b + 1] - total[a], got

    def decode(self, ids) -> bytes:
        """The text of ids, without the blank that was set in front."""
        return b"".join([self.back[i] for i in ids])[1:]


class _Words:
    """The words of a text, looked up when one is asked for."""

    def __init__(self, own: list[bytes], index: np.ndarray):
        self.own, self.index = own, index

    def __getitem__(self, i: int) -> bytes:
        return self.own[self.index[i]]


def replaced(ids: np.ndarray, at: np.ndarray, changed: tuple) -> list[np.ndarray]:
    """The stretches whose concatenation is a path: the best ids with other ones in the places ``changed``."""
    out, end = [], 0
    for i, other in sorted(changed):
        out += [ids[end : at[i]], np.array(other, np.uint32)]
        end = at[i + 1]
    return [*out, ids[end:]]


def lattice_of(path: str) -> Lattice:
    """The lattice that this worker process keeps for a model file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Lattice(*load(path))
    return _ENCODERS[path]


def encoder(path: str):
    """(encode, decode): encode(texts, n) gives each text's n best (score, ids); decode(ids) gives a text's bytes back."""
    lattice = lattice_of(path)

    def encode(texts: list[str | None], n: int) -> list[list[tuple[float, list[int]]]]:
        got = lattice.segment(pa.array(texts, pa.string()), n)
        return [[(score, np.concatenate(replaced(ids, at, changed)).tolist()) for score, changed in paths] for ids, at, paths in got]

    return encode, lattice.decode


def encode(docs: DataFrame, path: str, n: int = BEST, with_ids: bool = True) -> DataFrame:
    """docs with, in place of text: n_pieces, ids_crc32 and score of the best segmentation, scores and ids_crc32s of the
    n best, round_trip (decoding gives the text back), and if asked ids and the decoded text."""
    common.small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != "text"]

    def crc(parts: list[np.ndarray]) -> int:
        value = 0
        for p in parts:
            value = zlib.crc32(np.ascontiguousarray(p, "<u4"), value)
        return value

    def run(batches):
        lattice = lattice_of(path)
        for b in batches:
            texts = b.column("text")
            got = list(lattice.segment(texts, n))
            first = [ids for ids, _, _ in got]
            again = [lattice.decode(ids.tolist()) for ids in first]
            cols = [
                pa.array([len(x) for x in first], pa.int64()), pa.array([crc([x]) for x in first], pa.int64()), pa.array([p[0][0] for _, _, p in got], pa.float64()),
                pa.array([[s for s, _ in p] for _, _, p in got], pa.list_(pa.float64())),
                pa.array([[crc(replaced(ids, at, c)) for _, c in p] for ids, at, p in got], pa.list_(pa.int64())),
                pa.array([common.utf8(t) == a for t, a in zip(texts.to_pylist(), again)], pa.bool_()),
            ]
            names = RESULTS[:6]
            if with_ids:
                cols += [pa.array([x.astype(np.int32) for x in first], pa.list_(pa.int32())), pa.array([None if t is None else a.decode("utf-8", "replace") for t, a in zip(texts.to_pylist(), again)], pa.string())]
                names += ["ids", "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=[*keep, *names])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    schema = f"{kinds}n_pieces long, ids_crc32 long, score double, nbest_scores array<double>, nbest_crc32s array<long>, round_trip boolean"
    return docs.mapInArrow(run, schema + ", ids array<int>, text string" * with_ids)
