"""Near-duplicate vectors by spherical-cap filters with random product codes."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import shuffle_width
from vicinal.llm.components import components
from vicinal.session import Scratch

#: Times that a pair at the least similarity shares a filter on average.
MEETINGS = 12.0
#: Vectors that share a filter with a vector by chance, on average; sets how far filters reach.
STRANGERS = 64.0
#: Independent product codes; filters of one code depend on each other, so a vector that one serves badly
#: has the others.
CODES = 12
#: Members of a filter compared in one task; a fuller filter is cut into parts, and every two parts are compared.
CELL_ROWS = 2048
#: Groups up to this size are compared together, in arrays over many groups.
SMALL = 24
BLOCKS = 2
LEAST_LENGTH = 16


#: Numbers that a step of decoding holds for its scores, and in code books kept from slice to slice.
SCORES_AT_ONCE, BOOK_NUMBERS = 4 << 20, 4 << 20


def _log_tail(log: np.ndarray) -> np.ndarray:
    """Logarithms of the sums of exp(log) from each place to the end."""
    top = log.max()
    # Far out both the terms and their sum underflow together in plain numbers; sums of logarithms do not.
    return np.logaddexp.accumulate((log - top)[::-1])[::-1] + top


def _cap_shares(dim: int, similarity: float, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the share of the unit sphere within `reach` of a direction, and of those points, how many of
    the points at `similarity` to them also are, by numerical integration over the coordinate in that direction."""
    grid = np.linspace(-1, 1, 8001)[1:-1]
    density, tails = [], []
    for d in (dim, dim - 1):
        log = (d - 3) / 2 * np.log1p(-(grid**2))
        tail = _log_tail(log)
        density.append(log)
        tails.append(tail - tail[0])
    both = np.zeros(len(reach))
    for k, r in enumerate(reach):
        inside_cap = grid >= r
        t = grid[inside_cap]
        need = (r - similarity * t) / np.sqrt((1 - similarity**2) * (1 - t**2))
        inside = np.where(need >= grid[-1], 0.0, np.exp(np.interp(need, grid, tails[1], left=0.0)))
        weight = np.exp(density[0][inside_cap] - density[0][inside_cap].max())
        both[k] = (weight * inside).sum() / weight.sum()
    return np.interp(reach, grid, tails[0]), both


@functools.lru_cache(maxsize=CODES)
def _kept_book(seed: int, dim: int, codes: int, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    return _drawn_book(seed, dim, codes, k, width)


def _drawn_book(seed: int, dim: int, codes: int, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the rotation's three rounds, and the short vectors of every block, of code k."""
    rng = np.random.default_rng([seed, dim, codes, k])
    signs = rng.choice([-1.0, 1.0], (3, BLOCKS * width))
    book = rng.standard_normal((BLOCKS, codes, width))
    book /= np.linalg.norm(book, axis=2, keepdims=True) * math.sqrt(BLOCKS)
    return signs, book


@functools.lru_cache(maxsize=256)
def plan_caps(dim: int, n: int, similarity: float, seed: int) -> Caps:
    return Caps.plan(dim, n, similarity, seed)


@dataclass(frozen=True)
class Caps:
    """Filter directions: in each of CODES product codes, all ways to join one short random vector a block."""

    dim: int
    codes: int  # short vectors of a block
    reach: float  # a filter holds the unit vectors with at least this product
    seed: int = 0

    @classmethod
    def plan(cls, dim: int, n: int, similarity: float, seed: int = 0) -> Caps:
        """Narrower caps, and more of them, for more vectors, so that chance meetings stay STRANGERS a vector."""
        size = cls(dim, 0, 0).padded
        reach = np.linspace(min(0.05, 1.5 / math.sqrt(size)), 0.97, 185)
        share, both = _cap_shares(size, similarity, reach)
        hits = MEETINGS / np.maximum(both, 1e-9)
        met = np.abs(np.log(hits) + share + math.log(max(n, 1) / STRANGERS))
        # A cap that hardly any pair shares is no choice.
        k = int(np.argmin(np.where(both > 1e-6, met, np.inf)))
        codes = math.exp((math.log(hits[k] / CODES) - share[k]) / BLOCKS)
        return cls(dim, max(2, math.ceil(codes)), float(reach[k]), seed)

    @property
    def padded(self) -> int:
        # Short vectors of one or two coordinates would have too few directions; zeros put before the rotation change no cosine.
        return max(LEAST_LENGTH, 1 << (self.dim - 1).bit_length())

    def _turn(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """A random rotation: three rounds of random signs and a Walsh-Hadamard transform."""
        out = np.zeros((len(x), self.padded))
        out[:, : x.shape[1]] = x
        for sign in signs:
            out *= sign
            h = 1
            while h < self.padded:
                pairs = out.reshape(len(x), -1, 2, h)
                out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), -1)
                h *= 2
            out /= math.sqrt(self.padded)
        return out

    def filters(self, x: np.ndarray) -> list[np.ndarray]:
        """Sorted numbers of all filters that hold each unit vector.

        Blocks are joined one after another; what can't reach the cap even with the best of all blocks left
        is dropped at once.
        """
        step = max(1, SCORES_AT_ONCE // self.codes)
        if len(x) > step:
            return [f for at in range(0, len(x), step) for f in self.filters(x[at : at + step])]
        found = [self._of_code(x, k) for k in range(CODES)]
        at = np.concatenate([a for a, _ in found])
        # The code and the number of coordinates are part of a filter's number.
        code = np.concatenate([c + ((np.int64(self.dim) * CODES + k) << 40) for k, (_, c) in enumerate(found)])
        order = np.lexsort((code, at))
        return np.split(code[order], np.searchsorted(at[order], np.arange(1, len(x))))

    def _of_code(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        width = self.padded // BLOCKS
        draw = _kept_book if CODES * self.codes * self.padded <= BOOK_NUMBERS else _drawn_book
        signs, book = draw(self.seed, self.dim, self.codes, k, width)
        turned = self._turn(x, signs).reshape(len(x), BLOCKS, width)
        scores = [turned[:, b] @ book[b].T for b in range(BLOCKS)]
        best = np.array([s.max(axis=1) for s in scores])
        left = np.vstack([np.cumsum(best[::-1], axis=0)[::-1], np.zeros(len(x))])
        at, total, code = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int64)
        for b in range(BLOCKS):
            joined = total[:, None] + scores[b][at]
            row, pick = np.nonzero(joined + left[b + 1][at][:, None] >= self.reach)
            at, total, code = at[row], joined[row, pick], code[row] * self.codes + pick
        return at, code


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member connected to each of `n` members by pairs."""
    parent = np.arange(n)
    while True:
        low = np.minimum(parent[i], parent[j])
        if (parent[i] == low).all() and (parent[j] == low).all():
            return parent
        np.minimum.at(parent, parent[i], low)
        np.minimum.at(parent, parent[j], low)
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _scale(values: np.ndarray, dims: np.ndarray) -> np.ndarray:
    """The largest component of each vector, by which they are divided first, so that no square is zero or infinite."""
    return np.maximum.reduceat(np.abs(values), np.cumsum(dims) - dims)


class _Held:
    """Rows of whole cells: filter, part bounds, own part, class, copies, unit vector, and smaller filters."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        numbers = lambda name: table[name].to_numpy()
        self.filter, self.low, self.high = numbers("filter"), numbers("low"), numbers("high")
        self.part, self.cls, self.copies = numbers("part"), numbers("_class"), numbers("copies")
        flat = lambda name: np.asarray(table[name].combine_chunks().flatten())
        sizes = lambda name: np.diff(np.asarray(table[name].combine_chunks().offsets))
        n = len(self.filter)
        self.dims, self.values = sizes("vector"), flat("vector").astype(np.float64)
        self.ends = np.cumsum(self.dims)
        self.values /= np.repeat(_scale(self.values, self.dims), self.dims)
        self.values /= np.repeat(np.sqrt(np.add.reduceat(self.values**2, self.ends - self.dims)), self.dims)
        lists, counts = flat("filters"), sizes("filters")
        self.lists = np.full((n, int(counts.max(initial=0))), -1)
        self.lists[np.repeat(np.arange(n), counts), np.arange(len(lists)) - np.repeat(np.cumsum(counts) - counts, counts)] = lists

    def units(self, rows: np.ndarray) -> np.ndarray:
        d = self.dims[rows[0]]
        return self.values[(self.ends[rows] - d)[:, None] + np.arange(d)]

    def first_meeting(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether no smaller filter holds both rows of each pair."""
        out = np.zeros(len(i), bool)
        for at in range(0, len(i), 8192):
            a, b = i[at : at + 8192], j[at : at + 8192]
            one, two = self.lists[a], self.lists[b]
            shared = ((one[:, :, None] == two[:, None, :]).any(axis=2) & (one >= 0)).any(axis=1)
            out[at : at + 8192] = ~shared
        return out

    def first_meeting_dense(self, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same for many pairs among few rows (`i`, `j` count in `rows`), by bit sets of smaller filters."""
        smaller = self.lists[rows]
        names, counts = np.unique(smaller[smaller >= 0], return_counts=True)
        names = names[counts > 1]
        if not len(names):
            return np.ones(len(i), bool)
        at = np.minimum(np.searchsorted(names, smaller), len(names) - 1)
        row, column = np.nonzero(names[at] == smaller)
        bits = np.zeros((len(rows), (len(names) + 7) // 8 * 8), bool)
        bits[row, at[row, column]] = True
        packed = np.packbits(bits, axis=1)
        out = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 16):
            out[k : k + (1 << 16)] = ~(packed[i[k : k + (1 << 16)]] & packed[j[k : k + (1 << 16)]]).any(axis=1)
        return out


def _compare(held: _Held, similarity: float):
    """Pairs of rows that are linked, each pair only where it meets first: the two classes and their copies."""
    n = len(held.filter)
    new = np.append(True, (held.filter[1:] != held.filter[:-1]) | (held.low[1:] != held.low[:-1]) | (held.high[1:] != held.high[:-1]))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    group = np.cumsum(new) - 1
    across = held.low != held.high
    small = (sizes <= SMALL)[group]
    ones, twos = [], []
    for shift in range(1, SMALL):
        i = np.flatnonzero((group[shift:] == group[:-shift]) & small[shift:])
        i = i[~across[i] | (held.part[i] != held.part[i + shift])]
        if not len(i):
            continue
        for at in range(0, len(i), 1 << 15):
            a = i[at : at + (1 << 15)]
            # A filter's number says the number of coordinates too, so all of a group have the same.
            for d in np.unique(held.dims[a]):
                a_d = a[held.dims[a] == d]
                near = a_d[np.einsum("ij,ij->i", held.units(a_d), held.units(a_d + shift)) >= similarity]
                ones.append(near)
                twos.append(near + shift)
    if ones:
        i, j = np.concatenate(ones), np.concatenate(twos)
        first = held.first_meeting(i, j)
        yield i[first], j[first]
    for g in np.flatnonzero(sizes > SMALL):
        rows = np.arange(starts[g], starts[g] + sizes[g])
        inside = not across[rows[0]]
        sides = [rows] if inside else [rows[held.part[rows] == p] for p in (held.low[rows[0]], held.high[rows[0]])]
        if not all(map(len, sides)):
            continue
        units = held.units(sides[-1])
        for at in range(0, len(sides[0]), 512):
            block = sides[0][at : at + 512]
            near_i, near_j = np.nonzero(held.units(block) @ units.T >= similarity)
            if inside:
                keep = near_j > near_i + at
                near_i, near_j = near_i[keep], near_j[keep]
            i, j = block[near_i], sides[-1][near_j]
            first = held.first_meeting_dense(rows, i - rows[0], j - rows[0])
            yield i[first], j[first]


def embedding_links(df: DataFrame, similarity: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 0) -> DataFrame:
    """Link vectors whose cosine is at least `similarity`: `id_col`, `n_links`, `component_id`, `kept`.

    Equal vectors are one class. Every class is listed under all filters (see `Caps`) that hold it; classes
    that share a filter are compared in double precision, so no pair below `similarity` links. A filter's
    members are compared in cells of bounded size, a large filter's in many tasks. A pair counts in the
    smallest filter that holds both, so links are added up without listing pairs, and each cell hands on
    no more edges than it has members. Pairs at the least similarity are found with a chance of about
    1 - e^-MEETINGS, closer ones more surely.

    Vectors that are null, zero, or hold null or non-finite components, and rows with a null id, link with
    nothing and are their own component; vectors of different length never link. Rows that repeat an id and
    vector are copies of each other. Any number of lengths, and vectors of any length, are taken. An empty table gives no
    rows; other columns are ignored.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector_col}`").alias("_v"))
    good = (
        F.col("_id").isNotNull()
        & F.col("_v").isNotNull()
        & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
        & F.exists("_v", lambda x: x != 0)
    )
    rows = rows.withColumn("_v", F.when(good, F.col("_v")))
    # Numbers of classes; the table is written once, which makes them stay.
    classes = scratch.save(
        rows.where("_v IS NOT NULL")
        .groupBy("_v")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("copies"))
        .withColumn("_class", F.monotonically_increasing_id()),
        "classes",
    )
    kind = classes.schema["_v"].dataType.simpleString()
    # How many vectors there are of each length, which decides about the filters of that length.
    per_length = classes.groupBy(F.size("_v").alias("_d")).agg(F.count("*").alias("like"))
    byte_count = classes.agg(F.coalesce(F.sum(F.size("_v").cast("long") * 8), F.lit(0))).first()[0]

    def decode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                vectors, like = part.column("vector").to_pylist(), part.column("like").to_pylist()
                found: list = [None] * len(vectors)
                for d in sorted({len(v) for v in vectors}):
                    mine = [k for k, v in enumerate(vectors) if len(v) == d]
                    x = np.array([vectors[k] for k in mine], np.float64)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    caps = plan_caps(d, like[mine[0]], similarity, seed)
                    for k, codes in zip(mine, caps.filters(x), strict=True):
                        found[k] = codes
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("_class", "copies", "vector")), pa.array(found, pa.list_(pa.int64()))],
                    ["_class", "copies", "vector", "filters"],
                )

    listed = scratch.save(
        classes.withColumn("_d", F.size("_v"))
        .join(per_length, "_d")
        .select("_class", "copies", F.col("_v").alias("vector"), "like")
        .repartition(max(spark.sparkContext.defaultParallelism, shuffle_width(spark, byte_count)), "_class")
        .mapInArrow(decode, f"_class long, copies long, vector {kind}, filters array<long>"),
        "filters",
    )
    # With each filter go the smaller ones, which tell whether a pair has met before.
    members = listed.select("_class", "copies", "vector", "filters", F.posexplode("filters").alias("_at", "filter")).withColumn(
        "filters", F.slice("filters", F.lit(1), F.col("_at"))
    )
    full = (
        listed.select(F.explode("filters").alias("filter"))
        .groupBy("filter")
        .count()
        .where(F.col("count") > CELL_ROWS)
        .select("filter", F.ceil(F.col("count") / (CELL_ROWS // 2)).cast("int").alias("parts"))
    )
    part = F.coalesce(F.pmod(F.xxhash64("_class"), F.col("parts")).cast("int"), F.lit(0))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    cells = (
        members.join(full, "filter", "left")
        .withColumn("part", part)
        .withColumn("_other", other)
        .select(
            "filter", F.least("part", "_other").alias("low"), F.greatest("part", "_other").alias("high"), "part", "_class", "copies", "vector", "filters",
        )
    )

    def compare(batches):
        def whole(batches):
            """Row batches that end where a cell does."""
            kept: list[pa.RecordBatch] = []
            for batch in batches:
                last = [batch.column(c)[-1].as_py() for c in ("filter", "low", "high")] if batch.num_rows else None
                if last is None:
                    continue
                keys = [batch.column(c).to_numpy() for c in ("filter", "low", "high")]
                same = (keys[0] == last[0]) & (keys[1] == last[1]) & (keys[2] == last[2])
                cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
                if cut:
                    yield _Held([*kept, batch.slice(0, cut)])
                    kept = []
                kept.append(batch.slice(cut))
            if kept:
                yield _Held(kept)

        for held in whole(batches):
            pairs = list(_compare(held, similarity))
            if not pairs:
                continue
            i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            if not len(i):
                continue
            names, at = np.unique(held.cls[np.concatenate([i, j])], return_inverse=True)
            links = np.bincount(at, held.copies[np.concatenate([j, i])], len(names)).astype(np.int64)
            root = names[_roots(len(names), at[: len(i)], at[len(i) :])]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(links), pa.array(root)], ["a", "links", "b"])

    # A class goes to each of its filters with its vector and, on average, half of its filters' numbers.
    carried = F.size("filters").cast("double") * (8 * F.size("vector") + 4 * F.size("filters") + 64)
    width = shuffle_width(spark, listed.agg(F.coalesce(F.sum(carried), F.lit(0.0))).first()[0])
    found = scratch.save(
        cells.repartition(width, "filter", "low", "high")
        .sortWithinPartitions("filter", "low", "high")
        .mapInArrow(compare, "a long, links long, b long"),
        "links",
    )
    roots = components(found.select("a", "b"), scratch)
    summed = found.groupBy(F.col("a").alias("_class")).agg(F.sum("links").alias("_links"))
    known = scratch.save(
        classes.select("_class", "_first", "copies", "_v")
        .join(summed, "_class", "left")
        .join(roots.select(F.col("node").alias("_class"), "root"), "_class", "left")
        .select("_v", "_first", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("_n"), F.coalesce("root", "_class").alias("_root")),
        "known",
    )
    least = known.groupBy("_root").agg(F.min("_first").alias("_least"))
    named = known.join(least, "_root").select("_v", "_n", "_least")
    component = F.coalesce("_least", "_id")
    return rows.join(named, "_v", "left").select(
        F.col("_id").alias(id_col),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )
