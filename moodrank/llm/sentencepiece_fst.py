"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three transducers are compiled from the model file into tables:

* N, the normaliser: one state, whose arcs rewrite a space as the meta symbol, and an arc that writes one before the text;
* P, the pieces: a trie in a double array, whose accepting states write a piece's id and lead back to the root;
* B, byte fallback: an arc for each character that is no piece, which writes the ids of its UTF-8 bytes.

Composing N o (P | B) with an input gives a lattice over the places between its characters; its arcs are the pieces
found by walking P from every place at once. The output is the shortest path in the tropical semiring, by
relaxing the arcs in the order of their ends. In a model of kind "unigram" an arc weighs the piece's
cost. In one that merges by rank, the weight depends on the piece before: 0 if merging the text of both by rank
leaves just these two, else infinity. A path of finite weight to a place is then the merged form of the text up
to there, of which there is one, so one state a place is enough and each place keeps one last piece.

No piece goes on after a word into a space, so a text is cut into words with the spaces before them; paths of words met
before are kept, and the lattices of many new words are composed and solved side by side, in arrays.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import mapped

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
DIRECTORY = "/opt/tokenizers"
MOST_WORDS = 150_000
"""Words whose paths a worker keeps, about 30 MB."""
PAIR_BITS = 20
"""Places for pairs of pieces whose weights a worker keeps, as a power of two; 9 bytes each, half of them used."""
TOGETHER = 60_000
"""Characters of words that are solved side by side."""
LONG_WORD = 200
"""Longer words are solved one by one, place by place."""
CHARACTERS = 0x110000
UNKNOWN_COST = 10.0
"""What a character without a piece costs more than the dearest piece, in a unigram model."""


def _fields(blob: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = blob[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(blob):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, blob[i : i + n]
            i += n
        else:
            n = {5: 4, 1: 8}[key & 7]
            yield key >> 3, struct.unpack("<f" if n == 4 else "<d", blob[i : i + n])[0]
            i += n


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of all i, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Trie:
    """P as a double array: from state s, symbol c leads to base[s] + c if check is s there."""

    def __init__(self, pieces: dict[str, int]):
        self.classes = np.zeros(CHARACTERS, np.int32)
        alphabet = sorted({ch for p in pieces for ch in p})
        self.classes[[ord(ch) for ch in alphabet]] = np.arange(1, len(alphabet) + 1)
        number = {ch: i for i, ch in enumerate(alphabet, 1)}
        root: dict = {}
        for p, i in pieces.items():
            node = root
            for ch in p:
                node = node.setdefault(number[ch], {})
            node[0] = i
        size = 4 * sum(map(len, pieces)) + 2 * len(alphabet) + 2
        base, check, accepts = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        free, queue = 1, [(0, root)]
        for state, node in queue:  # grows while it is read: breadth first
            symbols = sorted(c for c in node if c)
            if 0 in node:
                accepts[state] = node[0]
            if not symbols:
                continue
            while used[free]:
                free += 1
            at = max(free - symbols[0], 0)
            while any(used[at + c] for c in symbols):
                at += 1
            base[state] = at
            for c in symbols:
                used[at + c] = 1
                check[at + c] = state
                queue.append((at + c, node[c]))
        end = len(used.rstrip(b"\0")) + len(alphabet) + 1
        self.base, self.check, self.accepts = base[:end].copy(), check[:end].copy(), accepts[:end].copy()

    def arcs(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) of every piece in a row of symbols; symbol 0 is on no path."""
        start = np.flatnonzero(symbols)
        state, out = np.zeros(len(start), np.int32), []
        padded = np.concatenate([symbols, [0]])
        depth = 0
        while len(start):
            to = self.base[state] + padded[np.minimum(start + depth, len(symbols))]
            ok = self.check[to] == state
            start, state = start[ok], to[ok]
            depth += 1
            found = self.accepts[state]
            some = found >= 0
            out.append((start[some], start[some] + depth, found[some]))
        return tuple(np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out) if out else ((), (), ())))


class Model:
    """A model file's transducers, and the paths of words met before."""

    def __init__(self, blob: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.dummy_prefix, self.squeeze, charsmap, kind = True, True, b"", 1
        for number, value in _fields(blob):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(piece.get(2, 0.0))
                self.kinds.append(piece.get(3, 1))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                own = dict(_fields(value))
                charsmap, self.dummy_prefix, self.squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        if kind not in (1, 2) or charsmap or self.squeeze or not self.dummy_prefix:
            raise ValueError("only models of kind unigram or of merges that keep text as it is after a first space can be compiled")
        self.merges = kind == 2
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds the meta symbol inside")
        self.scores = {p: scores[i] for p, i in self.ids.items()}
        self.unknown = self.kinds.index(2)
        fallback = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == 6}
        self.fallback = np.array([fallback[b] for b in range(256)], np.int32) if len(fallback) == 256 else None
        self.longest = max(map(len, self.ids), default=1)
        self.trie = Trie(self.ids)
        self.count = len(self.pieces)
        self.single = np.full(CHARACTERS, -1, np.int32)  # B has an arc where this is -1
        for p, i in self.ids.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        self.costs = np.full(self.count, np.inf)
        self.costs[list(self.ids.values())] = [-self.scores[p] for p in self.ids]
        self.unknown_cost = UNKNOWN_COST - min(self.scores.values(), default=0.0)
        spell = {1: lambda p: p.replace(SPACE, " ").encode(), 6: lambda p: bytes([int(p[3:5], 16)]), 2: lambda p: b" \xe2\x81\x87 "}
        spellings = [spell.get(k, lambda p: b"")(p) for p, k in zip(self.pieces, self.kinds)]
        self.spelt = np.frombuffer(b"".join(spellings), np.uint8)
        self.spelt_lengths = np.array([len(x) for x in spellings], np.int64)
        self.spelt_starts = np.cumsum(self.spelt_lengths) - self.spelt_lengths
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.orders: dict[str, bool] = {}
        self.pairs = Pairs()
        self.forget()

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls(f.read())

    def forget(self) -> None:
        self.words, self.new = Words(), []
        self.words.model = self
        self.pool, self.starts, self.lengths = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def merged(self, text: str, until: int = 1) -> list[str]:
        """Pieces of a short text by merging the best pair again and again (leftmost
        of equals), to `until` pieces: defines the weights, and serves tests."""
        parts = list(text)
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def half(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the last merge makes a piece of; None of a character."""
        if piece not in self.halves:
            parts = self.merged(piece, 2)
            self.halves[piece] = tuple(parts) if len(parts) == 2 and len(piece) > 1 else None
        return self.halves[piece]

    def ordered(self, piece: str) -> bool:
        """Whether a piece and all it is made of rank after their parts, as a training by merges makes them."""
        if piece not in self.orders:
            parts = self.half(piece)
            self.orders[piece] = parts is None or all(self.ranked(x) > self.ranked(piece) and self.ordered(x) for x in parts)
        return self.orders[piece]

    def ranked(self, piece: str) -> float:
        return np.inf if len(piece) == 1 else self.scores.get(piece, -np.inf)

    def fits(self, left: str, right: str) -> bool:
        """Whether merging the text of both leaves both. It does unless, at some time, a part that ends the left
        one and a part that starts the right one merge before they are merged into what holds them."""
        if not (self.ordered(left) and self.ordered(right)):
            return self.merged(left + right) == [left, right]
        scores, ranked, x, x_ends = self.scores, self.ranked, left, -np.inf
        while True:
            y, y_ends = right, -np.inf
            while True:
                score = scores.get(x + y)
                if score is not None:
                    at = min(score, ranked(x), ranked(y))  # when both are there and can merge
                    if at > x_ends and at >= y_ends:
                        return False
                parts = self.half(y)
                if parts is None:
                    break
                y, y_ends = parts[0], scores[y]
            parts = self.half(x)
            if parts is None:
                return True
            x, x_ends = parts[1], scores[x]

    def weights(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the weight of each piece after another is finite; -1 on the left is the start."""
        # A character without a piece is in no piece: nothing merges with it.
        ok = (left < 0) | (left >= self.count) | (right >= self.count)
        bound = np.flatnonzero(~ok)
        keys = left[bound].astype(np.int64) * self.count + right[bound]
        found = self.pairs.values(keys)
        missing = found < 0
        if missing.any():
            new = np.unique(keys[missing])
            pieces, fits = self.pieces, self.fits
            self.pairs.add(new, np.array([fits(pieces[k // self.count], pieces[k % self.count]) for k in new.tolist()], np.int8))
            found[missing] = self.pairs.values(keys[missing])
        ok[bound] = found > 0
        return ok

    def paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words' shortest paths, one after the other, and their numbers."""
        text = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        symbols = self.trie.classes[text]
        symbols[ends] = 0
        a, b, piece = self.trie.arcs(symbols)
        # B's arcs, over characters that no piece is.
        inner = np.ones(len(text), bool)
        inner[ends] = False
        bare = np.flatnonzero(inner & (self.single[text] < 0))
        a, b, piece = (np.concatenate(x) for x in ((a, bare), (b, bare + 1), (piece, text[bare] + self.count)))
        offset = b - np.repeat(starts, ends - starts + 1)[a]
        order = np.argsort(offset.astype(np.int16), kind="stable")
        a, b, piece, offset = a[order], b[order], piece[order], offset[order]
        last, source = np.full(len(text), -1, np.int64), np.full(len(text), -1, np.int64)
        best = np.full(len(text), np.inf)
        best[starts] = 0
        cuts = np.flatnonzero(np.diff(offset, prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(offset)]):
            x, y, p = a[lo:hi], b[lo:hi], piece[lo:hi]
            live = best[x] < np.inf
            x, y, p = x[live], y[live], p[live]
            if self.merges:
                ok = self.weights(last[x], p)
                x, y, p = x[ok], y[ok], p[ok]
                d = best[x]
            else:
                d = best[x] + np.where(p < self.count, self.costs[np.minimum(p, self.count - 1)], self.unknown_cost)
                first = np.lexsort((x, d, y))
                x, y, p, d = x[first], y[first], p[first], d[first]
                least = np.flatnonzero(np.diff(y, prepend=-1))
                x, y, p, d = x[least], y[least], p[least], d[least]
            best[y], last[y], source[y] = d, p, x
        whole = best[ends] < np.inf
        at, which, found = ends[whole], np.flatnonzero(whole), []
        while len(at):
            found.append((which, last[at]))
            at = source[at]
            more = at != starts[which]
            at, which = at[more], which[more]
        word = np.concatenate([x for x, _ in found[::-1]] or [np.empty(0, np.int64)])
        out = np.concatenate([x for _, x in found[::-1]] or [np.empty(0, np.int64)])
        for w in np.flatnonzero(~whole & (ends > starts)):  # ranks that are not those of a training by merges
            parts = self.merged(words[w])
            word, out = np.concatenate([word, np.full(len(parts), w)]), np.concatenate([out, [self.ids.get(x, self.count + ord(x)) for x in parts]])
        order = np.argsort(word, kind="stable")
        return self.written(out[order], word[order], len(words))

    def written(self, out: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Outputs of arcs -> ids, with the bytes of B's arcs in their place."""
        bare = np.flatnonzero(out >= self.count)
        if len(bare):
            each = np.ones(len(out), np.int64)
            kinds, back = np.unique(out[bare], return_inverse=True)
            spelt = [self.spelling(int(k) - self.count) for k in kinds]
            each[bare] = np.array([len(x) for x in spelt])[back]
            ids = np.repeat(out, each)
            ids[ragged(np.cumsum(each)[bare] - each[bare], each[bare])] = np.concatenate([spelt[k] for k in back])
            out, word = ids, np.repeat(word, each)
        return out.astype(np.int32), np.bincount(word, minlength=n)

    def spelling(self, character: int) -> np.ndarray:
        if self.fallback is None:
            return np.array([self.unknown])
        return self.fallback[np.frombuffer(chr(character).encode("utf-8", "surrogatepass"), np.uint8)]

    def path(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """The shortest path of one long word, place by place."""
        n = len(word)
        best, last, source = [np.inf] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        best[0], known = 0.0, {}
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                p = self.ids.get(word[start:end])
                if p is None and end - start == 1:
                    p = self.count + ord(word[start])
                if p is None or best[start] == np.inf:
                    continue
                if self.merges:
                    key = (last[start], p)
                    if key not in known:
                        known[key] = bool(self.weights(np.array(key[:1]), np.array(key[1:]))[0])
                    d = best[start] if known[key] else np.inf
                else:
                    d = best[start] + (self.costs[p] if p < self.count else self.unknown_cost)
                if d < best[end]:
                    best[end], last[end], source[end] = d, p, start
        out, at = [], n
        while at and best[n] < np.inf:
            out.append(last[at])
            at = source[at]
        if not out and n:
            out = [self.ids.get(x, self.count + ord(x)) for x in self.merged(word)][::-1]
        return self.written(np.array(out[::-1], np.int64), np.zeros(len(out), np.int64), 1)

    def solve(self) -> None:
        """Paths of all new words."""
        pools, lengths = [self.pool], [self.lengths]
        at = 0
        while at < len(self.new):
            if len(self.new[at]) > LONG_WORD:
                found = self.path(self.new[at])
                at += 1
            else:
                end, held = at, 0
                while end < len(self.new) and held < TOGETHER and len(self.new[end]) <= LONG_WORD:
                    held += len(self.new[end]) + 1
                    end += 1
                found = self.paths(self.new[at:end])
                at = end
            pools.append(found[0])
            lengths.append(found[1])
        self.new = []
        self.pool, self.lengths = np.concatenate(pools), np.concatenate(lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def normalised(self, text: str) -> list[str]:
        """N: the words of a text, each behind its meta symbols."""
        words = text.replace(SPACE, " ").split(" ")
        if "" not in words:
            return words
        runs, spaces = [], 0
        for w in words:
            if w:
                runs.append(SPACE * spaces + w if spaces else w)
                spaces = 0
            else:
                spaces += 1
        return [*runs, SPACE * (spaces - 1)] if spaces else runs

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        numbers, counts = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                own = list(map(self.words.__getitem__, self.normalised(t)))
                counts[i] = len(own)
                numbers += own
        self.solve()
        numbers = np.array(numbers, np.int64)
        lengths = self.lengths[numbers]
        out = self.pool[ragged(self.starts[numbers], lengths)]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(counts)
        if len(self.words) > MOST_WORDS:
            self.forget()
        return out, upto[ends] - upto[ends - counts]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The inverse transducer: pieces, and runs of bytes, back to texts."""
        lengths = self.spelt_lengths[ids]
        raw = self.spelt[ragged(self.spelt_starts[ids], lengths)].tobytes()
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(counts)
        cuts = zip(upto[ends - counts].tolist(), upto[ends].tolist())
        return [raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in cuts]

    def decode(self, ids) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0]


class Pairs:
    """A hash table of numbers in arrays: key -> 0 or 1. It starts anew when it is half full."""

    def __init__(self, bits: int = PAIR_BITS):
        self.bits = bits
        self.keys, self.found, self.held = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int8), 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def values(self, keys: np.ndarray) -> np.ndarray:
        """-1 for what is not there."""
        out = np.full(len(keys), -1, np.int8)
        at, slot = np.arange(len(keys)), self.slots(keys)
        while len(at):
            there = self.keys[slot]
            hit = there == keys[at]
            out[at[hit]] = self.found[slot[hit]]
            on = ~hit & (there >= 0)
            at, slot = at[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New keys, each once."""
        if self.held + len(keys) > 1 << self.bits - 1:
            self.__init__(max(self.bits, int(len(keys)).bit_length() + 1))
        self.held += len(keys)
        slot = self.slots(keys)
        while len(keys):
            mine, first = np.unique(slot, return_index=True)
            first = first[self.keys[mine] < 0]
            self.keys[slot[first]], self.found[slot[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)


class Words(dict):
    """word -> its number; a new one is put on the list of words to solve."""

    model: Model

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.model.new.append(SPACE + word)
        return number


_models: dict[str, Model] = {}


def model(path: str | None = None) -> Model:
    """The compiled model, once in each Python worker."""
    path = path or f"{DIRECTORY}/{MODEL}"
    if path not in _models:
        _models[path] = Model.load(path)
    return _models[path]


def encode(
    docs: DataFrame,
    path: str | None = None,
    keep: tuple[str, ...] = ("doc_id",),
    columns: tuple[str, ...] = ("text", "ids", "decoded"),
    derive: tuple[T.StructType, Callable[[list[str | None], pa.Array, list[str | None]], list]] | None = None,
) -> DataFrame:
    """docs(*keep, text) -> *keep, then of text, ids array<int> and decoded string those in `columns`.

    derive: further columns, and a function that makes them in the worker from a slice's texts, ids and decoded
    texts, so that what a caller only digests is not sent back. Each row on its own, so no key's rows meet, and
    a slice of rows of bounded size at once. Null text gives null ids and null decoded; an empty text
    gives no ids. The text's own meta symbol comes back as a space, as the model has it."""
    types = {"text": T.StringType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
    new = T.StructType([T.StructField(c, types[c]) for c in columns] + (list(derive[0]) if derive else []))

    def prepare() -> Callable[[pa.RecordBatch], list]:
        m = model(path)

        def make(rows: pa.RecordBatch) -> list:
            texts = rows.column("text").to_pylist()
            flat, counts = m.encode_all(texts)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            absent = pa.array([t is None for t in texts], pa.bool_())
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=absent)
            decoded = [d if t is not None else None for t, d in zip(texts, m.decode_all(flat, counts))]
            made = {"text": rows.column("text"), "ids": ids, "decoded": decoded}
            return [made[c] for c in columns] + (derive[1](texts, ids, decoded) if derive else [])

        return make

    return mapped(docs, keep, new, prepare)
