"""Substring dedup: documents parsed into factors of the corpus, as in relative Lempel-Ziv.

The reference is the corpus itself. Its text is indexed by the hashes of its 13-word windows; the index is cut by
hash into reference blocks, and a block knows for each of its windows the place in the reference where it
stands first: the smallest document, and the word in it. A document is parsed greedily: a factor (place in the
document, reference document, place in it, length) begins at the first word whose window has a place in
a smaller document, and goes on as long as the next window of both is the same. At the boundary of a factor
the parse looks at every following word's window again, so windows that lie across two factors, or begin inside
one, are found too. A factor is never shorter than a window; the words that factors cover are removed.

Rows on the way are blobs. A group of documents (some megabytes) asks every reference block about its windows at once:
ascending hashes, the documents they are in, and their places, and of the documents only those that the slice
uses, so the bytes of a group do not grow with the number of blocks but for the slices' own headers. A window goes out
once for a group however often it repeats there; what has a place in the group itself is found there.
What the blocks answer meets the group's list of documents again, becomes runs, and goes to the texts.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, encoded, give_back, mapped, opened, packed, plane_packed, plane_unpacked, power_of_two, slices, squeezed, text_size, unpacked, window_hashes

WIDTH = 13
BLOCK_BYTES = 12_000_000
"""Bytes of text whose windows one reference block holds, about."""
GROUP_BYTES = 12_000_000
"""Bytes of text whose windows are sorted at once in a Python worker, about."""
SLICE, DOCUMENTS, ANSWER = 0, 1, 2
"""Kinds of rows: windows for a reference block, the documents of a group, a block's answer to a group."""


def _ascending(ids: np.ndarray) -> np.ndarray:
    """Signed integers as unsigned ones in the same order."""
    return ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _signed(ids: np.ndarray) -> np.ndarray:
    return (ids ^ np.uint64(1 << 63)).view(np.int64)


def _blob(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def _parts(blob: bytes, n: int) -> list[bytes]:
    cuts = np.cumsum([4 * n, *struct.unpack_from(f"<{n}I", blob)]).tolist()
    return [blob[a:b] for a, b in zip(cuts, cuts[1:])]


def _places(at: np.ndarray, doc: np.ndarray, place: np.ndarray) -> bytes:
    """Ascending places of a group with their place in the reference."""
    docs, which = np.unique(doc, return_inverse=True)
    return _blob(packed(at), packed(_ascending(docs)), plane_packed(which), plane_packed(place))


def _from_places(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, docs, which, place = _parts(blob, 4)
    return unpacked(at).astype(np.int64), _signed(unpacked(docs))[plane_unpacked(which)], plane_unpacked(place).astype(np.int64)


def _send(rows: list[tuple[int, int, np.ndarray]], blocks: int) -> Iterator[tuple[int, int, int, bytes]]:
    """rows: (doc_id, text key, window hashes) of a group. Yields rows (place, group, kind, blob)."""
    rows.sort(key=lambda r: r[:2])
    rows = [r for i, r in enumerate(rows) if not i or r[:2] != rows[i - 1][:2]]  # a row twice is sent once
    ids, keys = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    # The group's name follows from what is in it, so a task that runs again gives the same.
    group = xxhash.xxh3_64_intdigest(ids.tobytes() + keys.tobytes()) >> 1
    sizes = np.array([len(r[2]) for r in rows], np.int64)
    starts = np.cumsum(sizes) - sizes
    hashes = np.concatenate([r[2] for r in rows])
    row_of = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    order = np.argsort(hashes, kind="stable").astype(np.int32)  # rows go by doc_id, so the first of equal hashes is in the smallest document
    h, row = hashes[order], row_of[order]
    del hashes, row_of
    first = np.empty(len(h), bool)
    first[:1], first[1:] = True, h[1:] != h[:-1]
    reference = np.flatnonzero(first).astype(np.int32)[np.cumsum(first) - 1]  # where the first of equals stands in this order
    repeats = ids[row] > ids[row[reference]]
    # Of what has no smaller document here, one window of each row goes out: rows of one id are not each other's reference.
    new_row = np.empty(len(h), bool)
    new_row[:1], new_row[1:] = True, row[1:] != row[:-1]
    out = ~repeats & (first | new_row)
    known = np.flatnonzero(repeats)
    known = known[np.argsort(order[known])]
    own = row[reference[known]]
    table = (packed(_ascending(ids)), keys.tobytes(), plane_packed(starts))
    yield group % blocks, group, DOCUMENTS, _blob(*table, _places(order[known], ids[own], order[reference[known]] - starts[own]))
    h, at, row = h[out], order[out], row[out]
    shift = np.uint64(64 - max(1, blocks.bit_length() - 1))
    edges = np.searchsorted((h >> shift).astype(np.int64) if blocks > 1 else np.zeros(len(h), np.int64), np.arange(blocks + 1))
    for b in range(blocks):
        lo, hi = edges[b], edges[b + 1]
        if lo < hi:
            used, which = np.unique(row[lo:hi], return_inverse=True)
            yield b, group, SLICE, _blob(packed(h[lo:hi]), packed(_ascending(ids[used])), packed(used), plane_packed(which), plane_packed(at[lo:hi] - starts[row[lo:hi]]))


def _windows(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        rows: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def frame(out: list[tuple]) -> pa.RecordBatch:
            types = {"place": pa.int32(), "group": pa.int64(), "kind": pa.int32(), "blob": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types.values())], names=list(types))

        def flushed() -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            held = 0
            for r in _send(rows, blocks):
                out.append(r)
                held += len(r[3])
                if held > 4_000_000:
                    yield frame(out)
                    out, held = [], 0
            if out:
                yield frame(out)

        for batch in batches:
            for part in slices(batch):
                for doc_id, key, text in zip(part.column("doc_id").to_pylist(), part.column("key").to_pylist(), part.column("text").to_pylist()):
                    raw = encoded(text)
                    own = window_hashes(words.of(raw.split()), WIDTH)
                    if len(own):
                        rows.append((doc_id, key, own))
                        size += len(raw)
                    if size > GROUP_BYTES:
                        yield from flushed()
                        rows, size = [], 0
        if rows:
            yield from flushed()
        rows = []
        words.clear()
        give_back()

    return run


def _reference_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """All slices of one block -> for each group the windows that stand in a smaller document, and the first place
    of each; lists of documents go on as they are."""
    slice_ = pdf["kind"].to_numpy() == SLICE
    groups = pdf["group"].to_numpy()
    out = [(int(g), DOCUMENTS, b) for g, b in zip(groups[~slice_], pdf["blob"][~slice_])]
    hashes, docs, rows, places, lengths = [], [], [], [], []
    for blob in pdf["blob"][slice_]:
        h, ids, used, which, place = _parts(blob, 5)
        which = plane_unpacked(which)
        hashes.append(unpacked(h))
        docs.append(_signed(unpacked(ids))[which])
        rows.append(unpacked(used).astype(np.uint32)[which])
        places.append(plane_unpacked(place))
        lengths.append(len(which))
    if hashes:
        h, doc, row, place = np.concatenate(hashes), np.concatenate(docs), np.concatenate(rows), np.concatenate(places)
        del hashes, docs, rows, places
        order = np.argsort(h).astype(np.int32)
        h = h[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        many = ~(new & np.concatenate([new[1:], [True]]))  # windows that stand somewhere else too
        order, new = order[many], new[many]
        del h, many
        if len(order):
            cuts = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            owner = np.minimum.reduceat(doc[order], cuts)
            # The first place in that document. Of rows with its id it may be any one's.
            there = np.minimum.reduceat(np.where(doc[order] == owner[of], place[order], np.uint32(2**32 - 1)), cuts)
            hit = doc[order] > owner[of]
            order, of = order[hit], of[hit]
            back = np.argsort(order)
            order, of = order[back], of[back]
            ends = np.cumsum(lengths)
            edges = np.searchsorted(order, np.concatenate([[0], ends]))
            for g, lo, hi in zip(groups[slice_], edges, edges[1:]):
                if lo < hi:
                    at, w = order[lo:hi], of[lo:hi]
                    sort = np.lexsort((place[at], row[at]))
                    refs, which = np.unique(owner[w][sort], return_inverse=True)
                    out.append((int(g), ANSWER, _blob(packed_rows(row[at][sort]), plane_packed(place[at][sort]), packed(_ascending(refs)), plane_packed(which), plane_packed(there[w][sort]))))
    give_back()
    return pd.DataFrame(out, columns=["group", "kind", "blob"])


def packed_rows(rows: np.ndarray) -> bytes:
    return packed(rows.astype(np.uint64))


def factors_of(at: np.ndarray, row: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows at ascending places, each with its row and its place in the reference -> where factors start, and how many
    windows they go on for: as long as the next window of the row is the reference's next."""
    goes_on = (np.diff(at) == 1) & (np.diff(row) == 0) & (np.diff(doc) == 0) & (np.diff(place) == 1)
    starts = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    return starts, np.diff(np.concatenate([starts, [len(at)]]))


def _gathered(pdf: pd.DataFrame) -> pd.DataFrame:
    """A group's documents and what all blocks answered -> one row a document, with its factors."""
    kinds = pdf["kind"].to_numpy()
    ids, keys, starts, known = _parts(pdf["blob"][kinds == DOCUMENTS].iloc[0], 4)  # a group of the same rows elsewhere has the same
    ids, keys, starts = _signed(unpacked(ids)), np.frombuffer(keys, np.int64), plane_unpacked(starts).astype(np.int64)
    at, doc, place = ([x] for x in _from_places(known))
    for blob in pdf["blob"][kinds == ANSWER]:
        rows, own, refs, which, there = _parts(blob, 5)
        at.append(starts[unpacked(rows).astype(np.int64)] + plane_unpacked(own))
        doc.append(_signed(unpacked(refs))[plane_unpacked(which)])
        place.append(plane_unpacked(there).astype(np.int64))
    at, doc, place = np.concatenate(at), np.concatenate(doc), np.concatenate(place)
    out = []
    if len(at):
        # A window's smallest document among those found here and by the blocks.
        order = np.lexsort((place, doc, at))
        at, doc, place = at[order], doc[order], place[order]
        best = np.concatenate([[True], at[1:] != at[:-1]])
        at, doc, place = at[best], doc[best], place[best]
        row = np.searchsorted(starts, at, "right") - 1
        first, n = factors_of(at, row, doc, place)
        table = np.stack([at[first] - starts[row[first]], n, doc[first], place[first]]).astype("<i8")
        cuts = np.flatnonzero(np.diff(row[first], prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(first)]):
            r = row[first[lo]]
            out.append((ids[r], keys[r], _blob(*(plane_packed(x) for x in table[:2, lo:hi]), table[2, lo:hi].tobytes(), plane_packed(table[3, lo:hi]))))
    del at, doc, place
    give_back()
    return pd.DataFrame(out, columns=["doc_id", "key", "factors"]).astype({"doc_id": "int64", "key": "int64"})


def parsed(raw: list[bytes], blob: bytes | None, words: WordHashes) -> np.ndarray:
    """Rows (word, words, reference document, word in it) of a document's factors, in order. A blob holds each window's
    first place only; a window that repeats in the document refers to the same place everywhere."""
    if blob is None:
        return np.empty((0, 4), np.int64)
    start, n, doc, place = _parts(blob, 4)
    start, n, doc, place = plane_unpacked(start).astype(np.int64), plane_unpacked(n).astype(np.int64), np.frombuffer(doc, "<i8"), plane_unpacked(place).astype(np.int64)
    own = window_hashes(words.of(raw), WIDTH)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    h = own[np.repeat(start, n) + step]
    order = np.argsort(h)
    h = h[order]
    at = np.searchsorted(h, own)
    at[at == len(h)] = 0
    here = np.flatnonzero(h[at] == own)
    which = order[at[here]]
    doc, place = np.repeat(doc, n)[which], (np.repeat(place, n) + step)[which]
    first, n = factors_of(here, np.zeros(len(here), np.int64), doc, place)
    return np.stack([here[first], n + WIDTH - 1, doc[first], place[first]], axis=1)


def spans(factors: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) in words of what factors cover; those that touch or overlap are one span."""
    out: list[list[int]] = []
    for start, n in factors[:, :2].tolist():
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + n)
        else:
            out.append([start, start + n])
    return [tuple(x) for x in out]


FACTORS = "array<struct<start:int,words:int,ref_doc:bigint,ref_word:int>>"


def dedup(docs: DataFrame, keep: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES, columns: tuple[str, ...] = ("text", "spans", "kept_text", "factors"), derive=None) -> DataFrame:
    """docs(doc_id, text, *keep) -> doc_id, *keep, n_words, n_removed, and of text, spans, kept_text and factors those
    in `columns`.

    spans are pairs of word numbers, kept_text the words outside joined by one space, factors the parse: start and words
    here, document and word there. derive: further columns, and a function that makes them in the worker from a
    slice's lists of texts and kept texts. Null text has no words (kept_text empty); a document without an id is neither
    reference nor parsed; rows of one id are not each other's reference, whether alike or not, and a factor that refers
    to such an id may mean any of them. Shorter documents than a window keep everything. Memory of a task: one
    reference block. `keep` may not name `key`, `z`, `factors` or a new column; other columns are ignored."""
    # The spread over partitions follows the files; a document's key tells rows of one id apart.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text", F.xxhash64("text").alias("key"))
    blocks = power_of_two(text_size(docs) / block_bytes)
    sent = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "key", "text").mapInArrow(_windows(blocks), "place int, group long, kind int, blob binary")
    answers = sent.groupBy("place").applyInPandas(_reference_block, "group long, kind int, blob binary")
    found = answers.groupBy("group").applyInPandas(_gathered, "doc_id long, key long, factors binary")
    found = found.dropDuplicates(["doc_id", "key"])  # a row twice has the same factors twice
    # Rows without an id go past the join, as they would be one key of it.
    named = squeezed(rows.where("doc_id IS NOT NULL")).join(found, ["doc_id", "key"], "left")
    unnamed = squeezed(rows.where("doc_id IS NULL")).withColumn("factors", F.lit(None).cast("binary"))
    joined = named.unionByName(unnamed).select("doc_id", *keep, F.col("z").alias("text"), "factors")
    types = {"text": "string", "spans": "array<int>", "kept_text": "string", "factors": FACTORS}
    schema = T.StructType().add("n_words", "long").add("n_removed", "long")
    for c in columns:
        schema = schema.add(c, T._parse_datatype_string(types[c]))
    for f in derive[0] if derive else []:
        schema = schema.add(f)

    def prepare() -> Callable[[pa.RecordBatch], list]:
        words = WordHashes()

        def make(part: pa.RecordBatch) -> list:
            texts = [None if z is None else opened(z) for z in part.column("text").to_pylist()]
            made: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "spans", "kept_text", "factors")}
            for text, blob in zip(texts, part.column("factors").to_pylist()):
                raw = encoded(text).split() if text is not None else []
                own = parsed(raw, blob, words)
                cut, left, end = spans(own), raw, 0
                if cut:
                    left = []
                    for a, b in cut:
                        left += raw[end:a]
                        end = b
                    left += raw[end:]
                made["n_words"].append(len(raw))
                made["n_removed"].append(len(raw) - len(left))
                made["kept_text"].append(b" ".join(left).decode("utf-8", "surrogatepass"))
                if "spans" in columns:
                    made["spans"].append([x for s in cut for x in s])
                if "factors" in columns:
                    made["factors"].append([dict(zip(("start", "words", "ref_doc", "ref_word"), f)) for f in own.tolist()])
            made["text"] = texts
            return [made[c] for c in ("n_words", "n_removed", *columns)] + (derive[1](texts, made["kept_text"]) if derive else [])

        return make

    return mapped(joined, ("doc_id", *keep), schema, prepare, also=("factors",))


def sha256(text: str) -> str:
    return hashlib.sha256(encoded(text)).hexdigest()


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT r, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d),
g AS (SELECT r, doc_id, p, md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)) AS h,
        count(*) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n FROM w),
o AS (SELECT r, doc_id, p, min(doc_id) OVER (PARTITION BY h) AS owner FROM g WHERE n = 13),
c AS (SELECT DISTINCT r, p + unnest(range(13)) AS p FROM o WHERE owner < doc_id),
k AS (SELECT w.r, w.doc_id, w.p, w.word, c.p IS NOT NULL AS gone FROM w LEFT JOIN c ON w.r = c.r AND w.p = c.p),
s AS (SELECT r, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept FROM k GROUP BY r)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(s.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.r = s.r
"""
