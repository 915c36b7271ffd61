"""All-against-all distances inside cells of bounded size.

A cell is what one task compares at a time: a small bucket, or two blocks of a large one. Spark shuffles
and sorts rows by cell; `mapInArrow` then sees whole cells one after another, holding no more than one
batch or one cell. A row's side says what it takes part in:

    BOTH           compared with every other row of the cell
    LEFT, RIGHT    compared with the rows of the other half, both ways
    SOURCE, TARGET only sources get neighbours, only from targets
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.functions.distance import SQUARED_EUCLIDEAN, Distance, fold_squares, matrix
from vicinal.functions.sparse import Postings, Rows, is_sparse, pair_squares

BOTH, LEFT, RIGHT, SOURCE, TARGET = range(5)

SMALL_CELL = 1 << 14  # pairs up to which cells are compared together, not one by one; either way gives the same edges
EDGES_TOGETHER = 1 << 14  # edges in a batch that leaves a task
NO_GROUP = np.iinfo(np.int64).min  # stands for a null group, which is a group like others
PAIRS_AT_ONCE = 1 << 20  # bounds the temporary arrays of a task
SMALL_PAIRS_AT_ONCE = 1 << 18  # the same among small cells, where there are a dozen such arrays
BLOCK_BYTES = 16 << 20
FEWEST_ROWS, MOST_ROWS = 256, 16384
SPARSE_BLOCK_BYTES, MOST_SPARSE_ROWS = 32 << 20, 1 << 17
EDGE_SCHEMA = "src bigint, group_id int, dst bigint, distance double"


def repeats_of(distance: Distance) -> int | None:
    """For `top_k`: whether cells give one distance for a pair, or any, as a block function may round as it likes."""
    return 1 if distance is SQUARED_EUCLIDEAN else None


def block_rows_for(entries: float, entry_bytes: int = 8) -> int:
    """Rows per block, so that a block stays within BLOCK_BYTES, for rows of so many numbers."""
    return int(min(max(BLOCK_BYTES // (entry_bytes * max(entries, 1)), FEWEST_ROWS), MOST_ROWS))


def sparse_block_rows(total: int, rows: int) -> int:
    """Rows per block of sparse vectors that carry `total` numbers together: a hash deals them out, long ones too."""
    return int(min(max(SPARSE_BLOCK_BYTES * rows // (12 * max(total, 1)), FEWEST_ROWS), MOST_SPARSE_ROWS))


def block_rows_column(rows: DataFrame) -> Column:
    """The same, from the vector a row carries."""
    carried = 12 * F.size("features.indices") if is_sparse(rows) else 8 * F.size("features")
    fitting = F.lit(BLOCK_BYTES) / F.greatest(carried, F.lit(8))
    return F.floor(F.least(F.greatest(fitting, F.lit(FEWEST_ROWS)), F.lit(MOST_ROWS)))


def block_of(id_column: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(id_column), blocks).cast("int")


def split_into_cells(rows: DataFrame, blocks: Column) -> DataFrame:
    """Give every row the cells it belongs to: its bucket, or each pair of blocks its block is in."""
    own = block_of(F.col("id"), F.col("_blocks"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda other: F.struct(
            F.concat_ws("/", F.col("bucket"), F.least("_own", other), F.greatest("_own", other)).alias("cell"),
            F.when(other == F.col("_own"), BOTH)
            .when(F.col("_own") < other, LEFT)
            .otherwise(RIGHT)
            .cast("tinyint")
            .alias("side"),
        ),
    )
    return (
        rows.withColumn("_blocks", F.greatest(F.lit(1), blocks.cast("int")))
        .withColumn("_own", own)
        .select("*", F.inline(pairs))
        .drop("_blocks", "_own", "bucket")
    )


def cell_edges(cells: DataFrame, k: int, distance: Distance, tasks: int, place: Column | None = None) -> DataFrame:
    """The k nearest of every node, per cell and group: one shuffle of (cell, side, id, group_id, features)."""
    rows = cells.select("cell", "side", "id", "group_id", "features", *([place.alias("_place")] if place is not None else []))
    if place is not None:
        rows = rows.repartitionById(tasks, F.col("_place")).drop("_place")
    else:
        rows = rows.repartition(tasks, "cell")
    rows = rows.sortWithinPartitions(F.xxhash64("cell"), "cell", "side")

    own = None
    if distance is not SQUARED_EUCLIDEAN:
        own = (distance.block, distance.nearly, distance.of_rows, distance.symmetric)
        if is_sparse(rows):
            own = (distance.sparse_block, None, None, distance.symmetric)
        if own[0] is None:
            raise ValueError(f"the distance {distance.name} has no form for sparse vectors")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _whole_cells(batches):
            yield from _gathered(_compare_cells(piece, k, own))

    return rows.mapInArrow(compare, EDGE_SCHEMA)


def whole_lists(rows: DataFrame, k: int, tasks: int) -> DataFrame:
    """The k nearest of every node among the members of all its buckets, with their `rank`: edges that nothing has to merge.

    `rows` have (id, group_id, features, buckets); ids are unique. Each of `tasks` tasks gets all rows, in one shuffle, and
    finds the lists of its own share of them, a slice at a time.
    """
    share = F.pmod(F.xxhash64("id"), F.lit(tasks)).cast("int")
    dealt = rows.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("_place"), share.alias("_share"), "*")
    dealt = dealt.repartitionById(tasks, F.col("_place"))
    dealt = dealt.select((F.col("_share") == F.col("_place")).alias("mine"), "id", "group_id", "features", "buckets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _gathered(_lists_of(pa.Table.from_batches(held), k))

    return dealt.mapInArrow(compare, f"{EDGE_SCHEMA}, rank int")


def _lists_of(table: pa.Table, k: int) -> Iterator[tuple]:
    """Ranked lists of the rows that are `mine`."""
    table = table.combine_chunks()
    column = {name: table.column(name).chunk(0) for name in table.column_names}
    ids, mine = (column[name].to_numpy(zero_copy_only=False) for name in ("id", "mine"))
    groups = pc.fill_null(column["group_id"].cast(pa.int64()), NO_GROUP).to_numpy(zero_copy_only=False)
    targets = np.argsort(groups, kind="stable")
    lengths = pc.list_value_length(column["buckets"]).to_numpy(zero_copy_only=False)
    bucket = column["buckets"].flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    place = np.empty(len(ids), np.int64)
    place[targets] = np.arange(len(ids))
    # Places of each bucket's members among the targets, bucket by bucket; and where the buckets of each row begin.
    order = np.argsort(bucket, kind="stable")
    members, upto = np.repeat(place, lengths)[order], np.append(0, np.cumsum(np.bincount(bucket)))
    begin = np.append(0, np.cumsum(lengths))

    def among(part: np.ndarray) -> np.ndarray:
        out = np.zeros((len(part), len(ids)), bool)
        for row, met in zip(part.tolist(), out):
            for b in bucket[begin[row] : begin[row + 1]].tolist():
                met[members[upto[b] : upto[b + 1]]] = True
        return out

    for src, dst, d in _block(matrix(column["features"]), ids, groups, np.flatnonzero(mine), targets, k, None, among=among):
        first = np.flatnonzero(np.append(True, (src[1:] != src[:-1]) | (groups[dst[1:]] != groups[dst[:-1]])))
        rank = np.arange(1, len(src) + 1) - np.repeat(first, np.diff(np.append(first, len(src))))
        yield ids[src], groups[dst], ids[dst], d, rank


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no cell is cut in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cell = batch.column(0)
        if held and held[-1].column(0)[-1] != cell[0]:
            yield pa.Table.from_batches(held)
            held = []
        changes = _changes(cell)
        if len(changes):
            yield pa.Table.from_batches([*held, batch.slice(0, changes[-1])])
            held = [batch.slice(changes[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _changes(values: pa.Array) -> np.ndarray:
    """Positions whose value differs from the one before."""
    differs = pc.not_equal(values.slice(1), values.slice(0, len(values) - 1))
    return np.flatnonzero(differs.to_numpy(zero_copy_only=False)) + 1


def _gathered(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Edges of many cells in batches of a useful size."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= EDGES_TOGETHER:
            yield _edge_batch(*map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield _edge_batch(*map(np.concatenate, zip(*held)))


def _compare_cells(piece: pa.Table, k: int, own: tuple | None) -> Iterator[tuple]:
    piece = piece.combine_chunks()
    column = {name: piece.column(name).chunk(0) for name in piece.column_names}
    ids, sides = (column[name].to_numpy(zero_copy_only=False) for name in ("id", "side"))
    groups = pc.fill_null(column["group_id"].cast(pa.int64()), NO_GROUP).to_numpy(zero_copy_only=False)
    vectors = column["features"]
    x = Rows.of(vectors) if pa.types.is_struct(vectors.type) else matrix(vectors)
    starts = np.concatenate([[0], _changes(column["cell"])])
    sizes = np.diff(np.append(starts, len(ids)))

    # Each row's partners are one run of rows, because rows are sorted by side inside a cell.
    start, end = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
    middle = start + np.repeat(np.add.reduceat(np.isin(sides, (LEFT, SOURCE)).astype(np.int64), starts), sizes)
    low = np.select([(sides == BOTH) | (sides == RIGHT), sides == TARGET], [start, end], middle)
    high = np.where(sides == RIGHT, middle, end)

    together = np.add.reduceat(high - low, starts) <= (SMALL_CELL if own is None else 0)
    for src, dst, d in _small_cells(x, ids, groups, np.flatnonzero(np.repeat(together, sizes)), low, high, k):
        yield ids[src], groups[dst], ids[dst], d
    for first, size in zip(starts[~together], sizes[~together]):
        rows = np.arange(first, first + size)
        if own is not None and own[-1] and (sides[rows] == LEFT).any() and (groups[rows] == groups[first]).all():
            left, right = (rows[sides[rows] == side] for side in (LEFT, RIGHT))
            for src, dst, d in _block(x, ids, groups, left, right, k, own, back=True):
                yield ids[src], groups[dst], ids[dst], d
            continue
        for span in np.unique(np.stack([low[rows], high[rows]], axis=1), axis=0):
            sources = rows[(low[rows] == span[0]) & (high[rows] == span[1])]
            targets = np.arange(*span)
            targets = targets[np.argsort(groups[targets], kind="stable")]
            for src, dst, d in _block(x, ids, groups, sources, targets, k, own):
                yield ids[src], groups[dst], ids[dst], d


def _edge_batch(src, group_id, dst, distance, rank=None) -> pa.RecordBatch:
    ranks = [] if rank is None else [pa.array(rank, pa.int32())]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(src, pa.int64()),
            pa.array(np.where(group_id == NO_GROUP, 0, group_id), pa.int32(), mask=group_id == NO_GROUP),
            pa.array(dst, pa.int64()),
            pa.array(distance, pa.float64()),
            *ranks,
        ],
        names=["src", "group_id", "dst", "distance", "rank"][: 4 + len(ranks)],
    )


def _small_cells(x, ids, groups, rows, low, high, k):
    """Rows of many small cells, every pair of a cell at once."""
    xt = None if isinstance(x, Rows) else np.ascontiguousarray(x.T)
    counts = (high - low)[rows]
    chunk = np.cumsum(counts) // SMALL_PAIRS_AT_ONCE
    for part in np.split(rows, np.flatnonzero(np.diff(chunk)) + 1):
        count = (high - low)[part]
        src = np.repeat(part, count)
        dst = np.arange(len(src)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[part], count)
        other = ids[src] != ids[dst]
        src, dst = src[other], dst[other]
        if len(src):
            d = pair_squares(x, src, x, dst) if xt is None else fold_squares(xt, xt, src, dst)
            crowded = (high - low)[src] > k
            if crowded.any():
                kept = np.flatnonzero(crowded)
                kept = kept[_nearest(src[kept], groups[dst[kept]], d[kept], ids[dst[kept]], k)]
                kept = np.concatenate([np.flatnonzero(~crowded), kept])
                src, dst, d = src[kept], dst[kept], d[kept]
            yield src, dst, d


def _nearest(src, group, d, dst, k) -> np.ndarray:
    """Positions of the k smallest (distance, id) of every (source, group)."""
    order = np.lexsort((dst, d, group, src))
    src, group = src[order], group[order]
    new = np.concatenate([[True], (src[1:] != src[:-1]) | (group[1:] != group[:-1])])
    starts = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def _bound(d: np.ndarray, k: int) -> np.ndarray:
    """A value for each row that at least k of its entries do not exceed, seldom many more.

    With enough columns it is the k-th smallest of the minima of groups of columns.
    """
    per_group = min(32, d.shape[1] // (8 * k))
    if per_group < 2:
        return np.partition(d, k - 1, axis=1)[:, k - 1]
    width = d.shape[1] // per_group
    least = d[:, :width].copy()
    for at in range(width, per_group * width, width):
        np.minimum(least, d[:, at : at + width], out=least)
    return np.partition(least, k - 1, axis=1)[:, k - 1]


def _bounds(d: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """For each row and each run of columns, a value that at least k of the run's entries do not exceed.

    Runs of like size are cut out together and selected from in one step, whatever their number.
    """
    if len(sizes) == 1:
        return _bound(d, k)[:, None] if sizes[0] > k else np.full((len(d), 1), np.inf)
    out = np.full((len(d), len(sizes)), np.inf)
    wide = np.column_stack([d, np.full(len(d), np.inf)])
    width_of = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    for width in np.unique(width_of[sizes > k]).tolist():
        runs = np.flatnonzero((width_of == width) & (sizes > k))
        span = np.arange(sizes[runs].max())
        at = np.where(span < sizes[runs, None], starts[runs, None] + span, d.shape[1])
        out[:, runs] = np.partition(wide[:, at], k - 1, axis=2)[:, :, k - 1]
    return out


class _Squares:
    """Squared distances to some rows: nearly, by a matrix product, with how far off it may be; and exactly."""

    def __init__(self, x: np.ndarray, targets: np.ndarray):
        self.x, b = x, x[targets]
        self.center = b.mean(axis=0)
        centered = b - self.center
        self.norms = np.einsum("ij,ij->i", centered, centered)
        self.rounding = 4 * (x.shape[1] + 8) * np.finfo(float).eps
        self.bt = np.ascontiguousarray(b.T)
        self.centered = np.ascontiguousarray(-2.0 * centered.T)

    def nearly(self, part: np.ndarray):
        a = self.x[part] - self.center
        norms = np.einsum("ij,ij->i", a, a)
        d = a @ self.centered
        d += self.norms
        d += norms[:, None]
        return d, self.rounding * (np.sqrt(norms) + np.sqrt(self.norms.max())) ** 2

    def exactly(self, part, i, j, d):
        return fold_squares(np.ascontiguousarray(self.x[part].T), self.bt, i, j)


class _SparseSquares:
    """The same for compressed rows, by an inverted index from coordinates to rows."""

    def __init__(self, x: Rows, targets: np.ndarray):
        self.x, self.b = x, x.take(targets)
        self.postings, self.norms = Postings(self.b), self.b.squares()
        self.most = self.b.counts.max(initial=0)

    def nearly(self, part: np.ndarray):
        a = self.x.take(part)
        norms = a.squares()
        d = self.postings.products(a)
        d *= -2.0
        d += self.norms
        d += norms[:, None]
        rounding = 4 * (a.counts.max(initial=0) + self.most + 8) * np.finfo(float).eps
        return d, rounding * (np.sqrt(norms) + np.sqrt(self.norms.max())) ** 2

    def exactly(self, part, i, j, d):
        return pair_squares(self.x, part[i], self.b, j)


class _Own:
    """The caller's own distance."""

    def __init__(self, x, targets, own):
        self.rows = x.take if isinstance(x, Rows) else x.__getitem__
        self.b, (self.block, nearly, self.of_rows, _) = self.rows(targets), own
        self.roughly = nearly(self.b) if nearly and self.of_rows else None

    def nearly(self, part: np.ndarray):
        if self.roughly:
            d, off = self.roughly(self.rows(part))
            return d, np.full(len(part), off)
        return np.array(self.block(self.rows(part), self.b), dtype=np.float64), np.zeros(len(part))

    def exactly(self, part, i, j, d):
        return self.of_rows(self.rows(part[i]), self.b[j]) if self.roughly else d[i, j]


class _Back:
    """The k nearest sources of each target, while slices of sources pass by."""

    def __init__(self, ids: np.ndarray, targets: np.ndarray, k: int):
        self.ids, self.targets, self.k = ids, targets, k
        #: What the k-th nearest so far does not exceed, by target; and what was kept: targets' places, sources, distances.
        self.bound = np.full(len(targets), np.inf)
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.more: list[tuple] = []

    def add(self, measure, part, d, slack, same, own) -> None:
        off = slack.max()
        if not len(self.kept[0]) and not self.more and len(part) >= self.k:
            self.bound = np.partition(d, self.k - 1, axis=0)[self.k - 1] + off
        near = d <= _raised(self.bound + off, d.dtype)
        near[same, own] = False
        i, j = np.divmod(np.flatnonzero(near), d.shape[1])
        self.more.append((j, part[i], measure.exactly(part, i, j, d)))
        if sum(len(m[0]) for m in self.more) >= max(len(self.kept[0]), self.k * len(self.targets)):
            self._settle()

    def _settle(self) -> None:
        j, source, value = (np.concatenate(c) for c in zip(self.kept, *self.more, strict=True))
        best = _nearest(j, np.zeros(len(j), np.int8), value, self.ids[source], self.k)
        self.kept, self.more = (j[best], source[best], value[best]), []
        # Sorted by target and distance: those with k of them know their k-th.
        count = np.bincount(self.kept[0], minlength=len(self.targets))
        full = np.flatnonzero(count >= self.k)
        self.bound[full] = np.minimum(self.bound[full], self.kept[2][np.cumsum(count)[full] - 1])

    def edges(self) -> tuple:
        self._settle()
        j, source, value = self.kept
        return self.targets[j], source, value


def _raised(bound: np.ndarray, dtype) -> np.ndarray:
    """Bounds in the type of the distances that they are held against, not lower than they were."""
    return bound if dtype == bound.dtype else np.nextafter(bound.astype(dtype), dtype.type(np.inf))


def _block(x, ids, groups, sources, targets, k, own, back=False, among=None):
    """The k nearest targets of each group for each source, in slices of the distance matrix.

    `targets` are sorted by group. `own` is the caller's own distance; with `back` all rows are of one group and the k nearest
    sources of each target come too, from the same distances. `among` tells of a slice which targets count. For squared distances a product gives
    approximate values; all targets within its rounding error of their group's k-th are then measured exactly, so the
    choice is that of the exact distances.
    """
    if len(sources) == 0 or len(targets) == 0:
        return
    if own is not None:
        measure = _Own(x, targets, own)
    else:
        measure = _SparseSquares(x, targets) if isinstance(x, Rows) else _Squares(x, targets)
    group = groups[targets]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(first, len(targets)))
    by_id = np.argsort(ids[targets], kind="stable")
    sorted_ids = ids[targets][by_id]
    reverse = _Back(ids, targets, k) if back else None
    step = max(1, PAIRS_AT_ONCE // len(targets))
    for at in range(0, len(sources), step):
        part = sources[at : at + step]
        d, slack = measure.nearly(part)
        # Every target that bears the source's id, however many.
        begin, end = (np.searchsorted(sorted_ids, ids[part], side=side) for side in ("left", "right"))
        same = np.repeat(np.arange(len(part)), end - begin)
        mine = by_id[np.arange(len(same)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + np.repeat(begin, end - begin)]
        d[same, mine] = np.inf
        apart = None if among is None else ~among(part)
        if apart is not None:
            d[apart] = np.inf
        bound = _raised(_bounds(d, first, sizes, k) + np.reshape(slack, (-1, 1)), d.dtype)
        near = d <= (bound if len(sizes) == 1 else np.repeat(bound, sizes, axis=1))
        near[same, mine] = False
        if apart is not None:
            near[apart] = False
        if reverse:
            reverse.add(measure, part, d, slack, same, mine)
        i, j = np.divmod(np.flatnonzero(near), len(targets))
        if len(i) == 0:
            continue
        value = measure.exactly(part, i, j, d)
        best = _nearest(i, group[j], value, ids[targets[j]], k)
        yield part[i[best]], targets[j[best]], value[best]
    if reverse:
        yield reverse.edges()
