"""Embedding near-dedup with an inverted multi-index.

Unit vectors are cut in halves, each half has its own codebook (k-means on a bounded sample), and the
pairs of codewords form a grid of cells; every vector is listed in its cell. A vector visits cells in
multi-sequence order: by how far the two halves must move before they could be nearest to that cell's
codewords, a heap holding the next candidates. It stops at the reach where the target recall is met: a set
of probe vectors is compared with all rows by brute force and the reach that their links need is
counted. Recall is then measured on the links of other probes. Visitors and members of a cell are compared in double precision, so nothing below the
threshold links; a link found from either side counts for both.

Equal vectors are one class with a weight. Members and visitors of a large cell are dealt into chunks
that meet pair by pair, so no task holds more than two chunks and no pair is listed: a chunk
pair returns link counts and a forest of its links.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved
from .components import components
from .topk_search import usable

THRESHOLD = 0.9
SAMPLE = 20_000
"""Vectors that the codebooks are fitted on, about."""
PROBES = 512
"""Vectors that set the reach, about; as many others measure its recall."""
TARGET = 1.0
CHUNK = 1024
BINS = 400
MARGIN = 1.25
"""The reach is this much larger than what the probes' links needed."""


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = distances(x, centres).argmin(axis=1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T
    return np.sqrt(np.maximum(d, 0))


class Grid:
    """Two codebooks; a cell's number is i * size + j."""

    def __init__(self, sample: np.ndarray, size: int):
        self.half = sample.shape[1] // 2
        self.books = [k_means(sample[:, : self.half], size), k_means(sample[:, self.half :], size)]
        self.size = max(len(b) for b in self.books)
        self.reach = np.inf

    def moves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each half, the square of how far a vector must move to be nearest to each codeword,
        at least: half of what the codeword is farther than the nearest."""
        out = []
        for part, book in zip((x[:, : self.half], x[:, self.half :]), self.books):
            d = distances(part, book)
            out.append(((d - d.min(axis=1, keepdims=True)) / 2) ** 2)
        return out[0], out[1]

    def cells(self, moves: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return moves[0].argmin(axis=1) * self.size + moves[1].argmin(axis=1)

    def visits(self, moves: tuple[np.ndarray, np.ndarray]) -> Iterator[list[int]]:
        """Cells by rising move, up to the reach, of each vector."""
        orders = [np.argsort(m, axis=1, kind="stable") for m in moves]
        for r in range(len(moves[0])):
            o1, o2 = orders[0][r], orders[1][r]
            m1, m2 = moves[0][r][o1].tolist(), moves[1][r][o2].tolist()
            heap, out = [(m1[0] + m2[0], 0, 0)], []
            while heap:
                move, a, b = heapq.heappop(heap)
                if move > self.reach:
                    break
                out.append(int(o1[a]) * self.size + int(o2[b]))
                # Each pair of places has one parent: down the second list, or along the first at its top.
                if b + 1 < len(m2):
                    heapq.heappush(heap, (m1[a] + m2[b + 1], a, b + 1))
                if b == 0 and a + 1 < len(m1):
                    heapq.heappush(heap, (m1[a + 1] + m2[0], a + 1, 0))
            yield out


def made_up_reach(grid: Grid, probes: np.ndarray, threshold: float, share: float = 0.99, each: int = 8) -> float:
    """The reach for `share` of made-up links, half-way between threshold and equality in random
    directions: the least reach, so that probes without links do not leave the index blind."""
    rng = np.random.default_rng(11)
    x = np.repeat(probes, each, axis=0)
    aside = rng.standard_normal(x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    c = (1 + threshold) / 2
    if x.shape[1] < 2:
        return 0.0
    y = c * x + np.sqrt(1 - c * c) * unit(np.where(np.abs(aside).max(axis=1, keepdims=True) > 0, aside, 1.0))
    cells, moves, rows = grid.cells(grid.moves(unit(y))), grid.moves(x), np.arange(len(x))
    return float(np.quantile(moves[0][rows, cells // grid.size] + moves[1][rows, cells % grid.size], share))


def needed_reach(classes: DataFrame, grid: Grid, setting: list, measuring: list, threshold: float, target: float) -> tuple[float, float | None]:
    """(reach, recall): the move that takes a probe to the cells of its links, or them to its own, counted over all rows in
    bins for the probes that set the reach; and the share of the other probes' links within it, None if they have none.
    Probes are (rep, vector); a vector is no link of its own."""
    top = 1 - threshold  # no link needs more: (0.2 - 0) / 2 squared distance at most
    edges = np.linspace(0, 2 * top, BINS + 1)
    probes = unit(np.array([v for _, v in setting + measuring]))
    reps = np.array([r for r, _ in setting + measuring], np.int64)
    probe_moves = grid.moves(probes)
    shared = classes.sparkSession.sparkContext.broadcast((grid, probes, reps, probe_moves, grid.cells(probe_moves), len(setting)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, p, ids, moves, cells, n_setting = shared.value
        total = np.zeros((2, BINS + 1), np.int64)
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                part = pdf.iloc[lo : lo + 4096]
                x = unit(np.stack(part["e"].to_numpy()))
                row, probe = np.nonzero((x @ p.T >= threshold) & (part["rep"].to_numpy()[:, None] != ids[None, :]))
                own = g.moves(x)
                at = g.cells(own)[row]
                there = moves[0][probe, at // g.size] + moves[1][probe, at % g.size]
                back = own[0][row, cells[probe] // g.size] + own[1][row, cells[probe] % g.size]
                bins = np.minimum(np.searchsorted(edges, np.minimum(there, back)), BINS)
                np.add.at(total, ((probe >= n_setting).astype(int), bins), 1)
        which, bins = np.nonzero(total)
        yield pd.DataFrame({"part": which, "bin": bins, "n": total[which, bins]})

    got = classes.select("rep", "e").mapInPandas(run, "part int, bin int, n long").groupBy("part", "bin").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, BINS + 1))
    np.add.at(counts, (got["part"].to_numpy(int), got["bin"].to_numpy(int)), got["n"].to_numpy(float))
    shared.destroy()
    upto = np.cumsum(counts, axis=1)
    at = int(np.searchsorted(upto[0], target * upto[0, -1]))
    reach = max(float(edges[min(at, BINS)] * MARGIN) if upto[0, -1] else 0.0, made_up_reach(grid, probes[: len(setting)], threshold))
    found = upto[1, min(BINS, max(0, int(np.searchsorted(edges, reach, "right")) - 1))]
    return reach, float(found / upto[1, -1]) if upto[1, -1] else None


def _links(pdf: pd.DataFrame, grid: Grid, threshold: float) -> pd.DataFrame:
    """One chunk of a cell's visitors against one of its members -> node, n_links, to."""
    visits = pdf["visits"].to_numpy()
    ids, weights = pdf["rep"].to_numpy(), pdf["w"].to_numpy()
    empty = pd.DataFrame({"node": np.empty(0, np.int64), "n_links": np.empty(0, np.int64), "to": np.empty(0, np.int64)})
    if not visits.any() or visits.all():
        return empty
    x = unit(np.stack(pdf["e"].to_numpy()))
    v, m, vi, mi, vw, mw = x[visits], x[~visits], ids[visits], ids[~visits], weights[visits], weights[~visits]
    linked = (v @ m.T >= threshold) & (vi[:, None] != mi[None, :])
    if not linked.any():
        return empty
    n_v = linked @ mw
    # A member counts a visitor only if it does not come to the visitor's cell by itself.
    own, visitor_cells = grid.moves(m), grid.cells(grid.moves(v))
    comes = own[0][:, visitor_cells // grid.size] + own[1][:, visitor_cells % grid.size] <= grid.reach
    n_m = (linked & ~comes.T).T @ vw
    label_v, label_m = vi.copy(), mi.copy()
    most = np.iinfo(np.int64).max
    while True:
        new_v = np.minimum(label_v, np.where(linked, label_m[None, :], most).min(axis=1))
        new_m = np.minimum(label_m, np.where(linked, new_v[:, None], most).min(axis=0))
        if (new_v == label_v).all() and (new_m == label_m).all():
            break
        label_v, label_m = new_v, new_m
    out = pd.DataFrame({"node": np.concatenate([vi, mi]), "n_links": np.concatenate([n_v, n_m]), "to": np.concatenate([label_v, label_m])})
    return out[(out["n_links"] > 0) | (out["node"] != out["to"])]


def _one_width(classes: DataFrame, threshold: float, target: float) -> tuple[DataFrame, float | None]:
    """classes(rep, e, w) of one vector length -> (node, n_links, to), and the recall measured."""
    spark = classes.sparkSession
    n = classes.count()
    kind = classes.schema["e"].dataType.simpleString()
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "rep"), F.lit(2**30)) / F.lit(float(2**30))
    drawn = lambda salt, most, share=1.0: [(r["rep"], r["e"]) for r in classes.where(draw(salt) < min(share, most / n)).select("rep", "e").orderBy("rep").collect()]
    some = lambda rows: rows or [(r["rep"], r["e"]) for r in classes.select("rep", "e").limit(1).collect()]
    grid = Grid(unit(np.array([v for _, v in some(drawn("sample", SAMPLE))])), int(np.clip(np.sqrt(n / 16), 2, 2048)))
    setting = some(drawn("probe", PROBES, 0.5))
    known = {r for r, _ in setting}
    grid.reach, recall = needed_reach(classes, grid, setting, [x for x in drawn("measure", PROBES) if x[0] not in known], threshold, target)
    shared = spark.sparkContext.broadcast(grid)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for pdf in batches:
            for lo in range(0, len(pdf), 2048):
                part = pdf.iloc[lo : lo + 2048]
                moves = g.moves(unit(np.stack(part["e"].to_numpy())))
                yield part.assign(cell=g.cells(moves), to_visit=list(g.visits(moves)))

    placed = saved(classes.mapInPandas(place, f"rep long, e {kind}, w long, cell long, to_visit array<long>"), "imi-placed")
    members = placed.select("rep", "e", "w", "cell", F.lit(False).alias("visits"))
    visitors = placed.select("rep", "e", "w", F.explode("to_visit").alias("cell"), F.lit(True).alias("visits"))
    both = members.unionByName(visitors)
    chunks = lambda visits: F.ceil(F.count_if(F.col("visits") == visits) / CHUNK).cast("int")
    sizes = both.groupBy("cell").agg(chunks(False).alias("mc"), chunks(True).alias("vc")).where("mc > 0")
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("visits"), F.col("vc")).otherwise(F.col("mc"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("visits"), F.col("mc")).otherwise(F.col("vc")) - 1))
    dealt = both.join(sizes, "cell").where("mc > 0 AND vc > 0").select("rep", "e", "w", "cell", "visits", own.alias("own"), other.alias("other"))
    dealt = dealt.select("rep", "e", "w", "cell", "visits", F.when(F.col("visits"), F.col("other")).otherwise(F.col("own")).alias("m"), F.when(F.col("visits"), F.col("own")).otherwise(F.col("other")).alias("v"))
    run = lambda pdf: _links(pdf, shared.value, threshold)
    return dealt.groupBy("cell", "m", "v").applyInPandas(run, "node long, n_links long, to long"), recall


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n_links, component_id, kept, recall.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing, as do
    vectors of different lengths; each is a component of its own. A row without an id links with nothing,
    has no component and is kept. Rows of one id are one node; a repeated vector links with its copies.
    `recall` is the share of probes' links that the index reaches, measured by brute force with probes that did not set
    its reach; null if they have no links. Components keep their type, float or double. Other columns are ignored."""
    kind = vectors.schema["embedding"].dataType
    held = "array<float>" if getattr(kind, "elementType", None) == T.FloatType() else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(held).alias("e"), F.col("embedding").cast("array<double>").alias("d"))
    able = usable(F.col("d")) & F.exists("d", lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("able", F.coalesce(able, F.lit(False))).drop("d")
    classes = rows.where("able").groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"))
    classes = saved(classes, "imi-classes")
    widths = [r["n"] for r in classes.groupBy(F.size("e").alias("n")).count().orderBy("n").collect()]
    out, worst = None, None
    for width in widths:
        own, recall = _one_width(classes.where(F.size("e") == width), threshold, target)
        out = own if out is None else out.unionByName(own)
        worst = min((r for r in (worst, recall) if r is not None), default=None)
    if out is None:
        found = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return found.select("*", F.lit(True).alias("kept"), F.lit(None).cast("double").alias("recall"))
    links = saved(out, "imi-links")
    parts = components(links.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")))
    counts = links.groupBy(F.col("node").alias("rep")).agg(F.sum("n_links").alias("n"))
    known = classes.join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("e", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    joined = rows.where("able").join(known, "e").select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("NOT able").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.lit(worst).cast("double").alias("recall"))
