"""N-gram Jaccard join with set-relation skipping, exact at its threshold.

Sets are distinct hashes of word runs, in one global order: by a size class of a hashed counter (how many
sets hold runs of that counter), then by hash. Two similar sets share a run among the first of both
(prefix filter), so only these are indexed, as lists (run -> set, position, size).

Index-level skipping: a list goes by position, in blocks that carry their least position and sizes; for a
set at position i, blocks are skipped whole whose positions leave too few runs behind for the overlap asked.
Answer-level skipping: the first rounds compare every set of a list only with a few sets of the list, the same
ones for most lists of a group of copies, others in each round. Sets linked so are one component, and an answer
of one is reachable from all: the last round enumerates lists completely, but pairs inside a component are
derived, not computed. What is left crosses components and is verified on the whole sets, every pair.

A listed set carries a parity bitmap of all its runs, of some bits for each. Each run that only one of two sets
holds flips one bit, so the bits in which two bitmaps differ are at most the runs not shared: where they are more
than a link allows, the pair cannot link and is not listed. Sets that share only a passage, and most of those just
below the threshold, end there, before they are rows. Bitmaps of unlike sizes meet folded to the smaller one.

Equal sets are one node. Index entries travel as blobs by ranges of runs; the lists made of them travel on by their
seeds, so that the lists of a group of copies meet in one bucket and its sets' bitmaps and labels are sent there once,
not once for each run. Texts of sets to compare are stored once a round.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, encoded, forget, give_back, mixed, opened, packed, plane_packed, plane_unpacked, power_of_two, saved, slices, squeezed, text_size, unpacked, window_hashes
from .components import components

WIDTH = 4
PERCENT = 85
COUNTER_BITS = 22
"""Hashed counters of how many sets hold a run: this many in all, whatever the input's size."""
COUNTER_CHUNK = 1 << 16
LIST_BYTES = 16_000_000
"""Bytes of text whose index entries one task holds, about."""
PLAIN = "none"
"""Codec of tables of long blobs that are dense already: others would hold whole pages of them outside the heap."""
GROUP_SETS = 20_000
MOST_SENT = 200_000
"""Up to so many sets to compare their documents' names are sent to every task, so that no other text is
compressed or shuffled; beyond, texts meet the names in a join."""
TURNS, SEEDS = 4, 10
"""Rounds that compare the sets of a list with a few of them, before the complete one: so many at most."""
LEAST_LINKED = 0.05
"""A round that links a smaller share of what it compares is the last one before the complete one: later ones
would mostly meet the same pairs again, which the complete round looks at anyway."""
LEAST_BITS, BITS_A_RUN = 256, 2
"""Bits of a set's parity bitmap: the power of two at or above so many for each run, so that a bitmap tells long
sets apart as well as short ones."""
BITMAP_WORDS = 500_000
"""Words of bitmaps compared at once."""
KEPT_BYTES = 16_000_000
"""Bytes of sets that a task verifying pairs keeps for the next ones; a larger set is kept alone."""
LONG_LIST = 1024
"""The lists of a group of similar sets are dealt to one bucket more for each so many sets in them."""
PAIRS_HELD = 1_000_000
"""Pairs that a task lists before it drops those it has twice and those that bitmaps rule out."""
SIFTED_LIST = 256
"""Up to so many sets in a list each is compared with all others by size and place, and left out if it can link with none."""
BLOCK = 256
"""Entries of a list that are skipped or compared at once."""


def runs_of(text: str, words: WordHashes, width: int = WIDTH) -> np.ndarray:
    """The set of a text: ascending distinct hashes; one hash for all its words if they are few."""
    own = words.of(encoded(text).translate(LOWER).split())
    if len(own) < width:
        return np.sort(window_hashes(own, len(own)) ^ np.uint64(len(own))) if len(own) else own
    return np.unique(window_hashes(own, width))


def _signed(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


def signature(runs: np.ndarray) -> int:
    return _signed(xxhash.xxh3_64_intdigest(runs.tobytes()))


def least_overlap(a, b, percent: int):
    """Of sets with a and b runs, the least intersection that links: 100 |x & y| >= percent |x | y|."""
    return -(-percent * (a + b) // (100 + percent))


def bitmap_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of the bitmaps of sets with n runs."""
    return 1 << np.ceil(np.log2(np.maximum(BITS_A_RUN * n, LEAST_BITS) / 64)).astype(np.int64)


def bitmap(runs: np.ndarray) -> bytes:
    """For each value of the runs' lowest bits, whether an odd number of runs has it."""
    bits = 64 * int(bitmap_words(np.array(len(runs))))
    return np.packbits(np.bincount((runs & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def prefix_length(n, percent: int):
    """Runs of a set that can hold the first one shared with a similar set of any size."""
    return n - -(-percent * n // 100) + 1


def index_length(n, percent: int):
    """The same for a similar set that is not smaller."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def can_link(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m runs can link when the run at their places i and j is the first they share."""
    behind = np.minimum(n - i, m - j)
    indexed = np.where(n <= m, i, j) < index_length(np.minimum(n, m), percent)
    return indexed & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (behind >= least_overlap(n, m, percent))


def _sketch(width: int):
    """Rows (doc_id, key, n, sig, bits) of every document, and (chunk, part, blob) of the partition's counters."""

    types = {"doc_id": pa.int64(), "key": pa.int64(), "n": pa.int64(), "sig": pa.int64(), "bits": pa.binary(), "chunk": pa.int32(), "part": pa.int32(), "blob": pa.binary()}

    def frame(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([x if isinstance(x := columns.get(c), pa.Array) else pa.array([x] * rows if not isinstance(x, list) else x, t) for c, t in types.items()], names=list(types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        counters = np.zeros(1 << COUNTER_BITS, np.uint32)
        shift = np.uint64(64 - COUNTER_BITS)
        seen: set[int] = set()

        def count(sets: list[np.ndarray]) -> None:
            at, n = np.unique((np.concatenate(sets) >> shift).astype(np.int32), return_counts=True)
            counters[at] += n.astype(np.uint32)

        for batch in batches:
            for part in slices(batch):
                n, sigs, bits, sets, size = [], [], [], [], 0
                for text in part.column("text").to_pylist():
                    runs = runs_of(text, words, width) if text is not None else np.empty(0, np.uint64)
                    n.append(len(runs))
                    sigs.append(signature(runs) if len(runs) else None)
                    bits.append(bitmap(runs) if len(runs) else None)
                    if len(runs) and sigs[-1] not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(sigs[-1])
                        sets.append(runs)
                        size += len(runs)
                    if size > 1_000_000:
                        count(sets)
                        sets, size = [], 0
                if sets:
                    count(sets)
                yield frame(len(n), doc_id=part.column("doc_id"), key=part.column("key"), n=n, sig=sigs, bits=bits, chunk=-1, part=0)
        words.clear()
        part_id = TaskContext.get().partitionId()
        for chunk, at in enumerate(range(0, len(counters), COUNTER_CHUNK)):
            own = counters[at : at + COUNTER_CHUNK]
            if own.any():
                yield frame(1, key=0, n=0, chunk=chunk, part=part_id, blob=[zlib.compress(plane_packed(own), 1)])
        give_back()

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(COUNTER_CHUNK, np.uint64)
    for blob in pdf["blob"]:
        total += plane_unpacked(zlib.decompress(blob))
    total = np.minimum(total, 2**32 - 1)
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "part": [0], "blob": [zlib.compress(plane_packed(total), 1)]})


def size_classes(counters: DataFrame) -> np.ndarray:
    """A class for each hashed counter: 0 up to twice the mean, then one more for each doubling. Of fixed
    size, so it can be sent to every task."""
    added = counters.withColumn("part", F.col("part") % 64).groupBy("chunk", "part").applyInPandas(_added, "chunk int, part int, blob binary")
    added = added.groupBy("chunk").applyInPandas(_added, "chunk int, part int, blob binary")
    total = np.zeros(1 << COUNTER_BITS, np.float64)
    for row in added.toLocalIterator():
        total[row["chunk"] * COUNTER_CHUNK : (row["chunk"] + 1) * COUNTER_CHUNK] = plane_unpacked(zlib.decompress(row["blob"]))
    usual = 2 * total.mean() + 8
    return np.where(total <= usual, 0, 1 + np.floor(np.log2(np.maximum(total / usual, 1)))).astype(np.uint8)


def in_order(runs: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return runs[np.argsort(classes[(runs >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)], kind="stable")]


def _index(shared, buckets: int, width: int, percent: int):
    """Documents -> (bucket, blob): slices of index entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, words = shared.value, WordHashes()
        sets: dict[int, tuple[int, np.ndarray]] = {}
        held = 0

        def frame(out: list[tuple[int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "blob"])

        def flushed() -> Iterator[pa.RecordBatch]:
            sigs = np.fromiter(sets, np.int64, len(sets))
            sizes = np.array([s[0] for s in sets.values()], np.int64)
            lengths = np.array([len(s[1]) for s in sets.values()], np.int64)
            run_ = np.concatenate([s[1] for s in sets.values()])
            owner = np.repeat(np.arange(len(sets)), lengths)
            place = np.arange(len(run_)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            order = np.argsort(run_)
            run_, owner, place = run_[order], owner[order], place[order]
            shift = np.uint64(64 - max(1, buckets.bit_length() - 1))
            edges = np.searchsorted((run_ >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(run_), np.int64), np.arange(buckets + 1))
            out = []
            for b in range(buckets):
                lo, hi = edges[b], edges[b + 1]
                if lo < hi:
                    used, own = np.unique(owner[lo:hi], return_inverse=True)
                    parts = (sigs[used].tobytes(), plane_packed(sizes[used]), packed(run_[lo:hi]), plane_packed(own), plane_packed(place[lo:hi]))
                    out.append((b, struct.pack("<5I", *map(len, parts)) + b"".join(parts)))
                if len(out) == 64:
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)

        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    runs = runs_of(text, words, width)
                    if not len(runs):
                        continue
                    sig = signature(runs)
                    if sig not in sets:
                        own = in_order(runs, classes)[: prefix_length(len(runs), percent)]
                        sets[sig] = (len(runs), own.copy())
                        held += len(own)
                    if held > 1_000_000 or len(sets) > GROUP_SETS:
                        yield from flushed()
                        sets, held = {}, 0
        if sets:
            yield from flushed()
        sets.clear()
        words.clear()
        give_back()

    return run


def _slice(blob: bytes) -> list[bytes]:
    cuts = np.cumsum([20, *struct.unpack_from("<5I", blob)])
    return [blob[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:])]


def _with_others(size: np.ndarray, place: np.ndarray, first: np.ndarray, length: np.ndarray, percent: int) -> np.ndarray:
    """Which entries, with the sets' sizes and places, can link with another of their list. Lists begin at `first`; of
    one longer than SIFTED_LIST all can."""
    able = np.zeros(len(size), bool)
    for n in np.unique(length):
        of = first[length == n]
        if n > SIFTED_LIST:
            able[(of[:, None] + np.arange(n)).ravel()] = True
            continue
        i, j = np.triu_indices(n, 1)
        step = max(1, PAIRS_HELD // 4 // len(i))
        for lo in range(0, len(of), step):
            part = of[lo : lo + step, None]
            x, y = (part + i).ravel(), (part + j).ravel()
            ok = can_link(size[x], place[x], size[y], place[y], percent)
            able[x[ok]] = able[y[ok]] = True
    return able


def _lists(buckets: int, percent: int):
    """All slices of a bucket of runs -> (bucket, blob): its lists of two sets and more that can link, by their seeds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sigs, sizes, runs, owners, places, n = [], [], [], [], [], 0
        for blob in pdf["blob"]:
            own, size, run_, owner, place = _slice(blob)
            sigs.append(np.frombuffer(own, np.int64))
            sizes.append(plane_unpacked(size))
            runs.append(unpacked(run_))
            owners.append(plane_unpacked(owner).astype(np.int64) + n)
            places.append(plane_unpacked(place))
            n += len(sigs[-1])
        sig, back = np.unique(np.concatenate(sigs), return_inverse=True)  # a set sent by several groups is one
        size = np.zeros(len(sig), np.uint32)
        size[back] = np.concatenate(sizes)
        run_, owner, place = np.concatenate(runs), back[np.concatenate(owners)], np.concatenate(places)
        del sigs, sizes, runs, owners, places, back
        order = np.lexsort((owner, run_))
        run_, owner, place = run_[order], owner[order], place[order]
        new = np.concatenate([[True], (run_[1:] != run_[:-1]) | (owner[1:] != owner[:-1])])
        run_, owner, place = run_[new], owner[new], place[new]
        first = np.flatnonzero(np.concatenate([[True], run_[1:] != run_[:-1]]))
        length = np.diff(np.concatenate([first, [len(run_)]]))
        first, length = first[length > 1], length[length > 1]
        able = _with_others(size[owner].astype(np.int64), place.astype(np.int64), first, length, percent)
        if len(first):
            left = np.concatenate([[0], np.cumsum(able)])
            first, length = left[first], left[first + length] - left[first]
            run_, owner, place = run_[able], owner[able], place[able]
            first, length = first[length > 0], length[length > 0]
        out = []
        if len(first):
            to = _seed_bucket(sig[owner], first, length, run_[first], buckets)
            order = np.argsort(to, kind="stable")
            first, length, to = first[order], length[order], to[order]
            ends = np.cumsum(length)
            entry = np.repeat(first - (ends - length), length) + np.arange(ends[-1])
            owner, place = owner[entry], place[entry]
            edges = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
            for lo, hi in zip(edges[:-1], edges[1:]):
                at, end = ends[lo] - length[lo], ends[hi - 1]
                used, own = np.unique(owner[at:end], return_inverse=True)
                parts = (sig[used].tobytes(), plane_packed(size[used]), plane_packed(own), plane_packed(place[at:end]), plane_packed(length[lo:hi]))
                out.append((int(to[lo]), struct.pack("<5I", *map(len, parts)) + b"".join(parts)))
        give_back()
        return pd.DataFrame({"bucket": pd.array([b for b, _ in out], "int32"), "blob": [x for _, x in out]})

    return run


def _seed_bucket(sigs: np.ndarray, first: np.ndarray, length: np.ndarray, run: np.ndarray, buckets: int) -> np.ndarray:
    """Lists, which begin at `first` of the entries' sigs -> the bucket of each. The lists of a group of similar sets have
    nearly the same sets and so few different seeds, the sets of least hash: a set is named in a few buckets however
    many there are, not in one for each of its runs. Lists of long groups are dealt to several, by their runs."""
    before = np.cumsum(length) - length
    seed = np.minimum.reduceat(mixed(sigs[np.repeat(first - before, length) + np.arange(length.sum())].view(np.uint64)), before)
    part = run % (1 + length.astype(np.uint64) // np.uint64(LONG_LIST))
    return (mixed(seed + part) % np.uint64(buckets)).astype(np.int64)


def _gathered(pdf: pd.DataFrame) -> pd.DataFrame:
    """All lists of a bucket -> one row with them and the sets in them."""
    sigs, sizes, owners, places, lengths, n = [], [], [], [], [], 0
    for blob in pdf["blob"]:
        own, size, owner, place, length = _slice(blob)
        sigs.append(np.frombuffer(own, np.int64))
        sizes.append(plane_unpacked(size))
        owners.append(plane_unpacked(owner).astype(np.int64) + n)
        places.append(place)
        lengths.append(plane_unpacked(length))
        n += len(sigs[-1])
    sig, back = np.unique(np.concatenate(sigs), return_inverse=True)
    size = np.zeros(len(sig), np.uint32)
    size[back] = np.concatenate(sizes)
    parts = (sig.tobytes(), plane_packed(size), plane_packed(back[np.concatenate(owners)]), plane_packed(np.concatenate([plane_unpacked(p) for p in places])), plane_packed(np.concatenate(lengths)))
    del sigs, sizes, owners, places, lengths, back
    give_back()
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "sigs": [sig.tolist()], "blob": [zlib.compress(struct.pack("<5I", *map(len, parts)) + b"".join(parts), 1)]})


def _fitted(left: pa.Table, right: pa.Table) -> pa.Table:
    """A bucket's lists and its sets' bitmaps (sig, bits) -> the lists with the bitmaps in the sets' order."""
    if not left.num_rows:
        return pa.table({"bucket": pa.array([], pa.int32()), "blob": pa.array([], pa.binary()), "maps": pa.array([], pa.binary())})
    order = np.argsort(right.column("sig").to_numpy())  # a bucket's lists name each of its sets once, in this order
    maps = right.column("bits").take(pa.array(order)).to_pylist()
    out = pa.table({"bucket": left.column("bucket"), "blob": left.column("blob"), "maps": pa.array([b"".join(maps)], pa.binary())})
    del maps
    give_back()
    return out


class Lists:
    maps: np.ndarray | None = None
    """Bitmaps of the sets, one behind the other; without them pairs go by sizes and places alone."""

    def __init__(self, blob: bytes, maps: bytes, percent: int):
        blob = zlib.decompress(blob)
        cuts = np.cumsum([20, *struct.unpack_from("<5I", blob)])
        self.sig = np.frombuffer(blob, np.int64, (cuts[1] - cuts[0]) // 8, cuts[0])
        self.size = plane_unpacked(blob[cuts[1] : cuts[2]]).astype(np.int64)
        self.owner = plane_unpacked(blob[cuts[2] : cuts[3]]).astype(np.int64)
        self.place = plane_unpacked(blob[cuts[3] : cuts[4]]).astype(np.int64)
        self.length = plane_unpacked(blob[cuts[4] : cuts[5]]).astype(np.int64)
        self.percent = percent
        self.fit(maps)

    def fit(self, maps: bytes) -> None:
        self.maps = np.frombuffer(maps, np.uint64)
        self.words = bitmap_words(self.size)
        self.start = np.cumsum(self.words) - self.words

    def can(self, a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
        return can_link(self.size[a], i, self.size[b], j, self.percent)

    def _maps(self, sets: np.ndarray, words: int) -> np.ndarray:
        """Bitmaps of sets, each folded to so many words: a bit of the half tells whether one of its two was set."""
        out = np.empty((len(sets), words), np.uint64)
        for w in np.unique(self.words[sets]):
            at = np.flatnonzero(self.words[sets] == w)
            own = self.maps[self.start[sets[at], None] + np.arange(w)]
            while own.shape[1] > words:
                own = own[:, : own.shape[1] // 2] ^ own[:, own.shape[1] // 2 :]
            out[at] = own
        return out

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether bitmaps of sets a and b differ in no more bits than linked sets of their sizes."""
        ok = np.ones(len(a), bool)
        if self.maps is None:
            return ok
        n, m = self.size[a], self.size[b]
        most = n + m - 2 * least_overlap(n, m, self.percent)  # runs that only one of them may hold
        words = np.minimum(self.words[a], self.words[b])
        for w in np.unique(words):
            at = np.flatnonzero(words == w)
            step = max(1, BITMAP_WORDS // int(w))
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                ok[part] = np.bitwise_count(self._maps(a[part], w) ^ self._maps(b[part], w)).sum(axis=1, dtype=np.int64) <= most[part]
        return ok

    def unique(self, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        a = np.concatenate([np.minimum(x, y) for x, y in found] or [np.empty(0, np.int64)])
        b = np.concatenate([np.maximum(x, y) for x, y in found] or [np.empty(0, np.int64)])
        pairs = np.unique(a * len(self.sig) + b)
        return pairs // max(1, len(self.sig)), pairs % max(1, len(self.sig))

    def sifted(self, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.unique(found)
        ok = self.alike(a, b)
        return a[ok], b[ok]

    def stars(self, label: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Every set of a list with the one of least hash in it; after the first turn with SEEDS more
        of them in each turn, and of any two labels only so many pairs, SEEDS times as many in each turn."""
        if not len(self.length):
            return self.unique([])
        starts = np.cumsum(self.length) - self.length
        which = np.repeat(np.arange(len(self.length)), self.length)
        kept, found, held = [], [], 0
        for k in range(SEEDS * turn or 1):
            rank = mixed(self.sig.view(np.uint64) + np.uint64(turn * 1000 + k)).argsort().argsort()[self.owner]
            seed = np.flatnonzero(rank == np.minimum.reduceat(rank, starts)[which])  # one in each list, in order
            s = seed[which]
            ok = (label[self.owner[s]] != label[self.owner]) & self.can(self.owner[s], self.place[s], self.owner, self.place)
            found.append((self.owner[s[ok]], self.owner[ok]))
            held += len(found[-1][0])
            if held > PAIRS_HELD:
                kept, found, held = [self.unique([*kept, self.sifted(found)])], [], 0
        a, b = self.unique([*kept, self.sifted(found)])
        if turn and len(a):
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            order = np.lexsort((mixed(self.sig[a].view(np.uint64) ^ self.sig[b].view(np.uint64)), high, low))
            a, b, low, high = a[order], b[order], low[order], high[order]
            first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
            nth = np.arange(len(a)) - np.repeat(first, np.diff(np.concatenate([first, [len(a)]])))
            a, b = a[nth < SEEDS**turn], b[nth < SEEDS**turn]
        return a, b

    def across(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every pair of a list with different labels that can link."""
        kept, found, held = [], [], 0
        starts = np.cumsum(self.length) - self.length
        for n in np.unique(self.length):
            of = starts[self.length == n]
            if n > 24:
                for at in of:
                    for pair in self._blocks(label, at, n):
                        found.append(pair)
                        held += len(pair[0])
                        if held > PAIRS_HELD:
                            kept, found, held = [self.unique([*kept, self.sifted(found)])], [], 0
                continue
            i, j = np.triu_indices(n, 1)
            for lo in range(0, len(of), max(1, PAIRS_HELD // 4 // len(i))):
                part = of[lo : lo + max(1, PAIRS_HELD // 4 // len(i)), None]
                x, y = (part + i).ravel(), (part + j).ravel()
                a, b = self.owner[x], self.owner[y]
                ok = label[a] != label[b]
                x, y, a, b = x[ok], y[ok], a[ok], b[ok]
                ok = self.can(a, self.place[x], b, self.place[y])
                found.append((a[ok], b[ok]))
                held += len(found[-1][0])
                if held > PAIRS_HELD:
                    kept, found, held = [self.unique([*kept, self.sifted(found)])], [], 0
        return self.unique([*kept, self.sifted(found)])

    def _blocks(self, label: np.ndarray, at: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own = np.arange(at, at + n)
        own = own[np.argsort(self.place[own], kind="stable")]
        blocks = [own[k : k + BLOCK] for k in range(0, n, BLOCK)]
        least = [(self.place[b].min(), self.size[self.owner[b]].min(), self.size[self.owner[b]].max(), np.unique(label[self.owner[b]])) for b in blocks]
        for p, x in enumerate(blocks):
            for q in range(p, len(blocks)):
                (i, small, big, mine), (j, low, high, others) = least[p], least[q]
                # A block's places leave at most its largest size less its least place behind; the least sizes ask for least_overlap.
                if min(high - j, big - i) < least_overlap(small, low, self.percent):
                    continue
                if len(mine) == 1 and len(others) == 1 and mine[0] == others[0]:
                    continue
                a, b = np.repeat(x, len(blocks[q])), np.tile(blocks[q], len(x))
                ok = (label[self.owner[a]] != label[self.owner[b]]) & (a != b if p != q else a < b)
                a, b = a[ok], b[ok]
                ok = self.can(self.owner[a], self.place[a], self.owner[b], self.place[b])
                if ok.any():
                    yield self.owner[a[ok]], self.owner[b[ok]]


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """pairs(a, b), texts(sig, z) -> a, b, linked, on the whole sets."""
    left = texts.select(F.col("sig").alias("a"), F.col("z").alias("text_a"))
    right = texts.select(F.col("sig").alias("b"), F.col("z").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, kept, held = WordHashes(), {}, 0

        def of(sig: int, text: bytes) -> np.ndarray:
            nonlocal held
            runs = kept.get(sig)
            if runs is None:
                runs = runs_of(opened(text), words, width)
                while kept and held + runs.nbytes > KEPT_BYTES:
                    held -= kept.pop(next(iter(kept))).nbytes
                kept[sig] = runs
                held += runs.nbytes
            return runs

        for pdf in batches:
            linked = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"]):
                x, y = of(a, ta), of(b, tb)
                linked.append(len(np.intersect1d(x, y, assume_unique=True)) >= least_overlap(len(x), len(y), percent))
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "linked": linked})
        words.clear()
        kept.clear()
        give_back()

    return both.mapInPandas(run, "a long, b long, linked boolean")


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, key, n_shingles, component_id, root.

    A set is the distinct runs of `width` words of the whole text, A-Z in lower case; all words as one run if they
    are fewer. Two documents link when 100 |x & y| >= percent |x | y|; component_id is the smallest
    doc_id reachable. Null, empty or blank texts have an empty set and are alone. A null id has no component.
    Rows of one id, alike or not, are separate sets with the same name. `key`, a hash of the text,
    tells them apart, and `root`, the same for all of a component, tells components apart whose smallest ids are
    one; it is null for what is alone by rule. Sets go by 64-bit hashes of their runs' hashes; other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    buckets = power_of_two(text_size(docs) / LIST_BYTES)
    sketch = saved(rows.mapInArrow(_sketch(width), "doc_id long, key long, n long, sig long, bits binary, chunk int, part int, blob binary"), "jaccard-sketch")
    sets = sketch.where("chunk < 0").select("doc_id", "key", "n", "sig")
    shared = docs.sparkSession.sparkContext.broadcast(size_classes(sketch.where("chunk >= 0").select("chunk", "part", "blob")))
    able = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    index = able.select("text").mapInArrow(_index(shared, buckets, width, percent), "bucket int, blob binary")
    by_seed = index.groupBy("bucket").applyInPandas(_lists(buckets, percent), "bucket int, blob binary")
    bare = saved(by_seed.groupBy("bucket").applyInPandas(_gathered, "bucket int, sigs array<long>, blob binary"), "jaccard-bare", PLAIN)
    shared.destroy()

    # Most sets are alone in all their lists: only the others' bitmaps travel.
    listed = saved(bare.select("bucket", F.explode("sigs").alias("sig")), "jaccard-listed")
    maps = sketch.where("sig IS NOT NULL").select("sig", "bits").join(listed.select("sig").distinct(), "sig", "left_semi").groupBy("sig").agg(F.any_value("bits").alias("bits"))
    of_bucket = listed.join(maps, "sig").select((F.col("bucket") + 0).alias("bucket"), "sig", "bits")
    lists = saved(bare.select("bucket", "blob").groupBy("bucket").cogroup(of_bucket.groupBy("bucket")).applyInArrow(_fitted, "bucket int, blob binary, maps binary"), "jaccard-lists", PLAIN)
    forget(bare)
    firsts = sets.where(F.col("doc_id").isNotNull()).groupBy("sig").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    rows_repeat = sets.groupBy("doc_id", "key").count().where("doc_id IS NOT NULL AND count > 1").limit(1).count() > 0

    def texts_of(pairs: DataFrame) -> DataFrame:
        """The text of one document of each set in pairs."""
        needed = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        of = saved(firsts.join(needed, "sig", "left_semi").select("sig", "first.doc_id", "first.key"), "jaccard-needed")
        if of.count() <= MOST_SENT:
            found = squeezed(able.join(F.broadcast(of), ["doc_id", "key"]).select("sig", "text"))
        else:
            found = squeezed(able).join(of, ["doc_id", "key"]).select("sig", "z")
        texts = saved(found.dropDuplicates(["sig"]) if rows_repeat else found, "jaccard-texts")
        forget(of)
        return texts

    def compared(select) -> DataFrame:
        """Pairs of each bucket by select(lists, labels)."""

        def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})]
            for blob, maps in zip(left["blob"], left["maps"]):
                own = Lists(blob, maps, percent)
                label = own.sig.copy()
                label[np.searchsorted(own.sig, right["node"].to_numpy())] = right["component"].to_numpy()
                a, b = select(own, label)
                out.append(pd.DataFrame({"a": own.sig[a], "b": own.sig[b]}))
            return pd.concat(out)

        return lists.groupBy("bucket").cogroup(named.groupBy("bucket")).applyInPandas(run, "a long, b long")

    # The smaller signature first, so that a pair is one row.
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    done = parts = None
    turn = 0
    while True:
        named = listed.withColumn("component", F.lit(None).cast("long")).where("false") if parts is None else listed.join(parts.withColumnRenamed("node", "sig"), "sig")
        named = named.select((F.col("bucket") + 0).alias("bucket"), F.col("sig").alias("node"), "component")
        found = ordered(compared((lambda own, label, turn=turn: own.stars(label, turn)) if turn < TURNS else Lists.across))
        pairs = saved(found if done is None else found.join(done, ["a", "b"], "left_anti"), "jaccard-pairs")
        texts = texts_of(pairs)
        own = saved(_verified(pairs, texts, width, percent), "jaccard-links")
        forget(texts)
        forget(pairs)
        done = own if done is None else done.unionByName(own)
        parts = components(done.where("linked").select("a", "b"))
        if turn < TURNS:
            share = own.agg(F.avg(F.col("linked").cast("double"))).head()[0] or 0.0
            turn = turn + 1 if share >= LEAST_LINKED else TURNS
        else:
            break
    forget(lists)
    forget(listed)
    rooted = sets.join(parts.withColumnRenamed("node", "sig"), "sig", "left").select("doc_id", "key", "n", F.coalesce("component", "sig").alias("root"))
    named = rooted.where("root IS NOT NULL AND doc_id IS NOT NULL")
    ids = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    alone = rooted.where("root IS NULL OR doc_id IS NULL")
    out = named.join(ids, "root").select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id", "root").unionByName(
        alone.select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    )
    out = saved(out, "jaccard")
    for table in (sketch, parts, done):
        forget(table)
    return out


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, doc_id, md5(array_to_string(w[i : i + 3], ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, doc_id, count(*) AS n FROM s GROUP BY r, doc_id),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.r = o.a JOIN n y ON y.r = o.b WHERE 100 * o.c >= 85 * (x.n + y.n - o.c)),
c(r, to_) AS (SELECT r, r FROM n UNION SELECT c.r, l.b FROM c JOIN l ON c.to_ = l.a),
m AS (SELECT c.r, min(n.doc_id) AS component_id FROM c JOIN n ON n.r = c.to_ GROUP BY c.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN m ON m.r = d.r
"""
