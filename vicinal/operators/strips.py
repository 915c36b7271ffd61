"""Exact graphs of sparse vectors in strips: a block of sources in memory, packed chunks of targets passing by.

A strip is one task: a block of sources and one group of the targets. Of every source only its k nearest are kept while targets pass,
so that a strip gives k edges of each and not k from every block. Vectors travel packed, many rows in a chunk of bytes.

Pairs without a common coordinate lie apart by the sum of their squared norms, so only pairs that the inverted index
names, and those of norms small enough, are looked at, unless many pairs have a coordinate in common.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.functions.sparse import Postings, Rows, pair_squares, runs
from vicinal.operators.cells import EDGE_SCHEMA, EDGES_TOGETHER, PAIRS_AT_ONCE, SOURCE, TARGET, _edge_batch, _nearest
from vicinal.session import Scratch
from vicinal.sources.points import PointStats

#: Bytes of the sources of a strip, as 12 an entry; of its packed targets; and rows and entries of a chunk at most.
SOURCE_BYTES, TARGET_BYTES, CHUNK_ROWS, CHUNK_ENTRIES = 32 << 20, 64 << 20, 4096, 1 << 16
#: Entries of the index that a step meets, and the share of all pairs from which on it takes them all.
MET_AT_ONCE, MANY = 1 << 20, 0.125
CHUNK_SCHEMA = "chunk bigint, norm double, rows int, size int, ids binary, counts binary, indices binary, x binary"


def strip_edges(points: DataFrame, k: int, stats: PointStats) -> DataFrame:
    """The k nearest of every source in each strip; `points` have `id` and sparse `features`."""
    spark = points.sparkSession
    cores = spark.sparkContext.defaultParallelism
    rows = min(max(stats.n // (16 * cores), 64), CHUNK_ROWS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                ids, x = batch.column("id").to_numpy(zero_copy_only=False), Rows.of(batch.column("features"))
                # Small norms first: where they come first, bounds are soon as tight as they get.
                order = np.argsort(x.squares(), kind="stable")
                ids, x = ids[order], x.take(order)
                row = np.arange(len(ids))
                cut = np.diff(row // rows) + np.diff(x.starts[:-1] // CHUNK_ENTRIES) > 0
                for some in np.split(row, np.flatnonzero(cut) + 1):
                    yield _packed(made, ids[some], x.take(some))
                    made += 1

    chunks = Scratch(spark).save(points.select("id", "features").mapInArrow(pack, CHUNK_SCHEMA), "chunks", large_rows=True)
    size = sum(F.length(c) for c in ("ids", "counts", "indices", "x"))
    told = chunks.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).first()
    blocks = max(math.ceil(12 * stats.total / SOURCE_BYTES), min(math.ceil(math.sqrt(2 * cores)), math.ceil(stats.n / 256)), 1)
    groups = max(math.ceil((told["bytes"] or 0) / TARGET_BYTES), min(math.ceil(2 * cores / blocks), told["n"]), 1)
    block, group = (F.pmod(F.xxhash64(F.lit(salt), "chunk"), F.lit(n)).cast("int") for salt, n in ((1, blocks), (2, groups)))

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sources = chunks.select("*", block.alias("_own"), every(groups).alias("_other"))
    targets = chunks.select("*", group.alias("_own"), every(blocks).alias("_other"))
    named = lambda df, code, cell: df.select(
        F.expr(cell).cast("int").alias("cell"), F.lit(code).cast("tinyint").alias("side"), *chunks.columns
    )
    cells = named(sources, SOURCE, f"_own * {groups} + _other").unionByName(named(targets, TARGET, f"_other * {groups} + _own"))
    cells = cells.repartitionById(blocks * groups, F.col("cell")).sortWithinPartitions("cell", "side", "norm")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, strip = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                cell, code = row["cell"].as_py(), row["side"].as_py()
                if cell != at:
                    if strip:
                        yield from strip.edges()
                    at, held, strip = cell, [], None
                chunk = _unpacked(row)
                if code == SOURCE:
                    held.append(chunk)
                elif held:
                    strip = strip or _Strip(held, k)
                    strip.meet(*chunk)
        if strip:
            yield from strip.edges()

    return cells.mapInArrow(compare, EDGE_SCHEMA)


def _packed(number: int, ids: np.ndarray, x: Rows) -> pa.RecordBatch:
    """Rows as compressed bytes: gaps between indices, and the bytes of all numbers by their place."""
    gaps = np.diff(x.indices, prepend=0)
    first = x.starts[:-1][x.counts > 0]
    gaps[first] = x.indices[first]
    parts = [(ids, "<i8"), (x.counts, "<i4"), (gaps, "<i4"), (x.values, "<f8")]
    raw = [np.ascontiguousarray(v.astype(t).view(np.uint8).reshape(len(v), -1).T).tobytes() for v, t in parts]
    columns = [pa.array([number], pa.int64()), pa.array([x.squares().min()]), *(pa.array([n], pa.int32()) for n in (len(ids), x.size))]
    columns += [pa.array([pa.compress(r, codec="zstd", asbytes=True)], pa.binary()) for r in raw]
    return pa.RecordBatch.from_arrays(columns, ["chunk", "norm", "rows", "size", "ids", "counts", "indices", "x"])


def _unpacked(row: dict) -> tuple[np.ndarray, Rows]:
    def numbers(name: str, n: int, kind: str) -> np.ndarray:
        width = np.dtype(kind).itemsize
        raw = pa.decompress(row[name].as_buffer(), decompressed_size=n * width, codec="zstd") if n else b""
        return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).reshape(n)

    n = row["rows"].as_py()
    ids, counts = numbers("ids", n, "<i8"), numbers("counts", n, "<i4").astype(np.int64)
    starts = np.append(0, np.cumsum(counts))
    gaps = numbers("indices", int(starts[-1]), "<i4").astype(np.int64)
    upto = np.append(0, np.cumsum(gaps))
    indices = upto[1:] - np.repeat(upto[starts[:-1]], counts)
    return ids, Rows(row["size"].as_py(), starts, indices, numbers("x", int(starts[-1]), "<f8"))


def _joined(parts: list[Rows]) -> Rows:
    counts = np.concatenate([p.counts for p in parts])
    return Rows(parts[0].size, np.append(0, np.cumsum(counts)), *(np.concatenate([getattr(p, c) for p in parts]) for c in ("indices", "values")))


class _Strip:
    """Sources, and their k nearest among the targets so far.

    Distances are found nearly, and exactly where they may be among the k nearest within what rounding leaves open.
    """

    def __init__(self, chunks: list[tuple[np.ndarray, Rows]], k: int):
        self.ids, self.x, self.k = np.concatenate([i for i, _ in chunks]), _joined([x for _, x in chunks]), k
        self.by_id = np.argsort(self.ids, kind="stable")
        self.postings, self.norms, self.most = Postings(self.x), self.x.squares(), self.x.counts.max(initial=0)
        self.longest = math.sqrt(self.norms.max(initial=0))
        #: What the k-th nearest so far does not exceed; and what is kept: places of sources, ids of targets, distances.
        self.bound = np.full(len(self.ids), np.inf)
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.more: list[tuple] = []
        self._room()

    def _room(self) -> None:
        """Sources by how much of their bound their own norm leaves: a target beyond all of it needs a common coordinate."""
        room = self.bound - self.norms
        self.roomiest = np.argsort(-room, kind="stable")
        self.room = -room[self.roomiest]

    def meet(self, ids: np.ndarray, x: Rows) -> None:
        norms = x.squares()
        off = 4 * (x.counts.max(initial=0) + self.most + 8) * np.finfo(float).eps * (np.sqrt(norms.max(initial=0)) + self.longest) ** 2
        post = self.postings
        at = np.minimum(np.searchsorted(post.coordinate, x.indices), max(len(post.coordinate) - 1, 0))
        met = post.coordinate[at] == x.indices if len(post.coordinate) else np.zeros(len(at), bool)
        work = np.append(0, np.cumsum(np.where(met, post.count[at] if len(post.count) else 0, 0)))[x.starts]
        begin = 0
        while begin < len(ids):
            end = max(int(np.searchsorted(work, work[begin] + MET_AT_ONCE, "right")) - 1, begin + 1)
            near = np.searchsorted(self.room, off - norms[begin:end], "right")
            end = begin + max(int(np.searchsorted(np.cumsum(near), MET_AT_ONCE, "right")), 1)
            near = near[: end - begin]
            if work[end] - work[begin] + near.sum() > MANY * (end - begin) * len(self.ids):
                end = min(end, begin + max(1, PAIRS_AT_ONCE // len(self.ids)))
                self._all(ids, x, norms, begin, end, off)
            else:
                self._few(ids, x, norms, begin, end, off, at, met, near)
            begin = end

    def _all(self, ids, x, norms, begin, end, off) -> None:
        """All pairs of some targets with the sources."""
        d = self.postings.products(x.take(np.arange(begin, end)))
        d *= -2.0
        d += self.norms
        d += norms[begin:end, None]
        i, j = self._same(ids[begin:end])
        d[i, j] = np.inf
        bound = self.bound
        if len(d) >= self.k:
            bound = np.minimum(bound, np.partition(d, self.k - 1, axis=0)[self.k - 1] + off)
        near = d <= bound + off
        near[i, j] = False
        i, j = np.divmod(np.flatnonzero(near), len(self.ids))
        self._hold(ids, x, begin + i, j)

    def _few(self, ids, x, norms, begin, end, off, at, met, near) -> None:
        """The pairs that share a coordinate, and those near by their norms alone."""
        post, n = self.postings, len(self.ids)
        span = slice(x.starts[begin], x.starts[end])
        row = np.repeat(np.arange(end - begin), x.counts[begin:end])[met[span]]
        place, value = at[span][met[span]], x.values[span][met[span]]
        count = post.count[place] if len(place) else np.zeros(0, np.int64)
        posting = runs(post.start[place], count) if len(place) else np.zeros(0, np.int64)
        pair = np.repeat(row, count) * n + post.row[posting]
        order = np.argsort(pair, kind="stable")
        pair, dot = pair[order], (np.repeat(value, count) * post.value[posting])[order]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
        pair = pair[first]
        dot = np.add.reduceat(dot, first) if len(first) else dot
        i, j = np.divmod(pair, n)
        pair = pair[norms[begin + i] + self.norms[j] - 2 * dot <= self.bound[j] + off]
        alone = np.repeat(np.arange(end - begin), near) * n + self.roomiest[runs(np.zeros(len(near), np.int64), near)]
        i, j = np.divmod(np.unique(np.concatenate([pair, alone])), n)
        other = ids[begin + i] != self.ids[j]
        self._hold(ids, x, begin + i[other], j[other])

    def _same(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that bear one id."""
        begin, end = (np.searchsorted(self.ids[self.by_id], ids, side=side) for side in ("left", "right"))
        return np.repeat(np.arange(len(ids)), end - begin), self.by_id[runs(begin, end - begin)]

    def _hold(self, ids, x, i, j) -> None:
        self.more.append((j, ids[i], pair_squares(x, i, self.x, j)))
        if sum(len(m[0]) for m in self.more) >= max(len(self.kept[0]) // 2, self.k * len(self.ids) // 2):
            self._settle()

    def _settle(self) -> None:
        j, target, value = (np.concatenate(c) for c in zip(self.kept, *self.more, strict=True))
        best = _nearest(j, np.zeros(len(j), np.int8), value, target, self.k)
        self.kept, self.more = (j[best], target[best], value[best]), []
        # Sorted by source and distance: those with k of them know their k-th.
        count = np.bincount(self.kept[0], minlength=len(self.ids))
        full = np.flatnonzero(count >= self.k)
        self.bound[full] = self.kept[2][np.cumsum(count)[full] - 1]
        self._room()

    def edges(self) -> Iterator[pa.RecordBatch]:
        self._settle()
        j, target, value = self.kept
        for at in range(0, len(j), EDGES_TOGETHER):
            some = slice(at, at + EDGES_TOGETHER)
            yield _edge_batch(self.ids[j[some]], np.zeros(len(j[some]), np.int64), target[some], value[some])
