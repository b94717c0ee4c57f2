"""Byte contexts of up to three symbols as a table automaton, scored by array lookups.

Both byte models of this subpackage need, for every place of a text, the cost of a symbol after
the longest known context. The contexts are compiled into dense tables: two lookups lead from
the three symbols before a place to its state, a third from state and symbol to the cost.
Symbols are bytes, and REPEAT for a word that equals the word before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

REPEAT = 256
START = 257
SYMBOLS = 258


class ContextTables:
    """contexts: tuples of one to three symbols; every suffix of a context must be there.
    cost(context) -> array (symbols,) or (symbols, classes) of costs after it."""

    def __init__(self, alphabet: Iterable[int], contexts: Iterable[tuple[int, ...]], cost: Callable[[tuple[int, ...]], np.ndarray]):
        known = sorted({a for a in alphabet if a != START})
        # Unknown symbols share the last class; START is a class of its own.
        self.classes = np.full(SYMBOLS, len(known), np.int32)
        self.classes[known] = np.arange(len(known), dtype=np.int32)
        self.classes[START] = len(known) + 1
        n = self.n = len(known) + 2
        symbols = [*known, None, START]
        states = sorted({(), *((s,) for s in symbols if s is not None), *contexts}, key=lambda c: (len(c), str(c)))
        index = {c: i for i, c in enumerate(states)}

        def longest(context: tuple) -> int:
            while context not in index:
                context = context[1:]
            return index[context]

        # pair[a * n + b]: a number for what can matter of the two symbols; own[b] if (a, b) is unknown.
        pairs = sorted({c[-3:-1] for c in states if len(c) == 3} | {c for c in states if len(c) == 2}, key=str)
        self.pair = np.empty(n * n, np.int32)
        self.pair.reshape(n, n)[:] = np.arange(n, dtype=np.int32)[None, :]
        rows: list[tuple] = [(s,) for s in symbols]
        where = {s: i for i, s in enumerate(symbols)}
        for p in pairs:
            self.pair[where[p[0]] * n + where[p[1]]] = len(rows)
            rows.append(p)
        self.state = np.empty(len(rows) * n, np.int32)
        for r, row in enumerate(rows):
            for j, s in enumerate(symbols):
                self.state[r * n + j] = index[()] if s is None else longest((*(x for x in row if x is not None), s) if None not in row else (s,))
        self.cost = np.stack([np.asarray(cost(c), np.float32) for c in states])
        self.cost = np.ascontiguousarray(self.cost.reshape(len(states) * n, *self.cost.shape[2:]))

    def costs(self, symbols: np.ndarray) -> np.ndarray:
        """The cost of every symbol of a text but the first three, which are START: the
        places before the text. Several texts can stand side by side, each with its own."""
        c = self.classes[symbols].astype(np.int64)
        state = self.state[self.pair[c[:-3] * self.n + c[1:-2]].astype(np.int64) * self.n + c[2:-1]]
        return self.cost[state.astype(np.int64) * self.n + c[3:]]


def stream(texts: list[bytes | np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as symbols, three START before each, and where each text's START are."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + 3)])
    out = np.full(starts[-1], START, np.int16)
    for text, at in zip(texts, starts):
        out[at + 3 : at + 3 + len(text)] = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    return out, starts


def sums(tables: ContextTables, texts: list[bytes | np.ndarray], most: int = 1_000_000) -> np.ndarray:
    """Total cost of each text, in pieces of bounded size for long ones; a place takes about 60 bytes meanwhile."""
    shape = tables.cost.shape[1:]
    out = np.zeros((len(texts), *shape))
    group: list[int] = []
    size = 0

    def flush() -> None:
        symbols, starts = stream([texts[i] for i in group])
        costs = tables.costs(symbols).astype(np.float64)
        # costs[k] belongs to symbols[k + 3]; those of START symbols do not count.
        costs[symbols[3:] == START] = 0
        out[group] += np.add.reduceat(costs, starts[:-1], axis=0)

    for i, text in enumerate(texts):
        if len(text) > most:
            symbols, _ = stream([text])
            for at in range(0, len(text), most):
                out[i] += tables.costs(symbols[at : at + most + 3]).sum(axis=0, dtype=np.float64)
            continue
        if not len(text):
            continue
        group.append(i)
        size += len(text)
        if size > most:
            flush()
            group, size = [], 0
    if group:
        flush()
    return out
