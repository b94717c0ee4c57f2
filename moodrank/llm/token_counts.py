"""Token counts by longest match, in time linear in the text, without building pieces.

The vocabulary's pieces form a trie: those that start a word under one root, those that go on
under another. Every state has a failure link, to the state of what is left when the
pieces that a longest match must by then have emitted are popped, and the number of those
pieces. A word is read byte by byte; where no edge goes on, the link is followed and its number
added. What is left at the end is popped in the same way.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import encoded, mapped

DIRECTORY = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
NONE = -1


class LongestMatch(dict):
    """Piece counts of words; itself the counts of words met before."""

    most = 150_000

    def __init__(self, starts: Iterable[bytes], others: Iterable[bytes]):
        self.edges: list[dict[int, int]] = [{}, {}]
        accepts: set[int] = set()
        for root, pieces in ((0, starts), (1, others)):
            for piece in pieces:
                node = root
                for byte in piece:
                    child = self.edges[node].get(byte)
                    if child is None:
                        child = self.edges[node][byte] = len(self.edges)
                        self.edges.append({})
                    node = child
                if node > 1:
                    accepts.add(node)
        self.link = [NONE] * len(self.edges)
        self.popped = [0] * len(self.edges)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for byte, node in self.edges[parent].items():
                queue.append(node)
                if node in accepts:
                    self.link[node], self.popped[node] = 1, 1
                    continue
                to, count = self.link[parent], self.popped[parent]
                while to != NONE and byte not in self.edges[to]:
                    count += self.popped[to]
                    to = self.link[to]
                if to != NONE:
                    self.link[node], self.popped[node] = self.edges[to][byte], count

    def __missing__(self, word: bytes) -> int:
        edges, link, popped = self.edges, self.link, self.popped
        state = count = 0
        for byte in word:
            while (to := edges[state].get(byte)) is None:
                if link[state] == NONE:
                    return self.keep(word, 1)
                count += popped[state]
                state = link[state]
            state = to
        while state > 1:
            if link[state] == NONE:
                return self.keep(word, 1)
            count += popped[state]
            state = link[state]
        return self.keep(word, count)

    def keep(self, word: bytes, count: int) -> int:
        """A word that no pieces cover counts as one unknown piece."""
        if len(self) > self.most:
            self.clear()
        if len(word) <= 64:
            self[word] = count
        return count

    @classmethod
    def byte_level(cls, path: str) -> LongestMatch:
        """From a file of base64 pieces and ranks, whose pieces that start a word start with
        a space. All 256 bytes are pieces; a word whose first letter has no piece with
        a space counts the space as a piece of its own."""
        with open(path, "rb") as f:
            pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
        return cls([p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "])


_automata: dict[str, LongestMatch] = {}


def automaton(path: str | None = None) -> LongestMatch:
    """Built once in each Python worker."""
    path = path or f"{DIRECTORY}/{VOCABULARY}"
    if path not in _automata:
        _automata[path] = LongestMatch.byte_level(path)
    return _automata[path]


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words long, n_tokens long; words as split at ASCII
    white space, each read with one space before it.

    Every row on its own. A null or empty text has 0 words and 0 tokens; other columns and
    repeated ids do not matter."""

    def prepare() -> Callable[[pa.RecordBatch], list]:
        counts = automaton(path)

        def make(rows: pa.RecordBatch) -> list:
            words = [[] if t is None else encoded(t).split() for t in rows.column("text").to_pylist()]
            return [list(map(len, words)), [sum(map(counts.__getitem__, [b" " + w for w in ws])) for ws in words]]

        return make

    return mapped(docs, ("doc_id",), T.StructType().add("n_words", "long").add("n_tokens", "long"), prepare)
