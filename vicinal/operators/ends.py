"""Pairs of ids with the rows of both ends, without sending a vector with every pair.

Both point tables are cut into blocks by a hash of their id. A cell is a block of each side with the pairs between the
two, or a part of these where they are many: its vectors come once, then its pairs pass by, batch after batch. A task
holds two blocks, whatever pairs there are. Where pairs are few, both ends are joined instead, with the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.functions.distance import SQUARED_EUCLIDEAN, fold_squares, matrix, squares_of_rows
from vicinal.functions.sparse import Rows, pair_squares
from vicinal.operators.cells import FEWEST_ROWS, block_of
from vicinal.session import Scratch, tasks_for
from vicinal.sources.points import found_or, join_kind, vector_entries

SIDE_BYTES = 32 << 20  # of a block, as doubles
PAIRS_IN_CELL = 1 << 21
FEWEST_PAIRS = 1 << 16
ROWS_OUT = 10000
FIRST, SECOND, PAIR = range(3)


def with_ends(
    pairs: DataFrame,
    sources: DataFrame,
    targets: DataFrame,
    missing: str = "error",
    measured: bool = False,
    first: str = "src",
    block_rows: int | None = None,
    by_cells: bool | None = None,
    either_way: bool = False,
) -> DataFrame:
    """`pairs` (src, dst and more) with `_a` and `_b`, structs of what the sources and targets have beside their id.

    With `measured` the squared distance of both `features` comes instead, as `distance`, with the groups of both ends
    as `group_a` and `group_b`. An id in several rows gives a row for each. A pair of an id without a point
    fails the job, or with `missing="drop"` is left out. `first` names the end that a join would look up first. With
    `either_way` the ends, of one table, may change places, which takes half the cells.
    """
    spark, kind = pairs.sparkSession, join_kind(missing)
    scratch = Scratch(spark)
    stored = scratch.save(pairs, "pairs")
    total, cores = stored.count(), spark.sparkContext.defaultParallelism
    # More blocks cost fewer copies than more parts of a cell, which are for cells that have most of the pairs.
    fewest = math.ceil(math.sqrt(max(2 * cores, 2 * total / PAIRS_IN_CELL)))
    sides = [_Side(sources, block_rows, fewest), _Side(targets, block_rows, fewest)]
    blocks = [F.lit(side.blocks) for side in sides]
    own = lambda c, n: block_of(F.col(c).cast("bigint"), blocks[n])
    placed = stored.withColumn("_i", own("src", 0)).withColumn("_j", own("dst", 1))
    if either_way:
        turn = {"src": "dst", "dst": "src", "_i": "_j", "_j": "_i"}
        placed = placed.withColumns({c: F.when(F.col("_i") > F.col("_j"), F.col(o)).otherwise(F.col(c)) for c, o in turn.items()})
    sizes = scratch.save(placed.groupBy("_i", "_j").agg(F.count(F.lit(1)).alias("_pairs")), "cells")
    most = min(max(total // cores, FEWEST_PAIRS), PAIRS_IN_CELL)
    cells = sizes.select("_i", "_j", F.ceil(F.col("_pairs") / most).cast("int").alias("_parts"))
    told = cells.agg(F.sum("_parts").alias("cells"), F.max("_parts").alias("parts")).first()
    copies = (told["cells"] or 0) * sum(math.ceil(side.n / side.blocks) for side in sides)
    if by_cells is None:
        by_cells = copies < 2 * total
    if not by_cells:
        return _joined(stored, sources, targets, missing, kind, measured, first)

    number = (F.col("_i").cast("long") * sides[1].blocks + F.col("_j")) * (told["parts"] or 1)
    width = sum(side.bytes for side in sides) / 2
    tasks = max(1, min(told["cells"] or 1, 4 * tasks_for(spark, copies * width + 64.0 * total)))
    more = [f for f in pairs.schema.fields if f.name not in ("src", "dst")]
    shapes = [T.StructType([f for f in df.schema.fields if f.name != "id"]) for df in (sources, targets)]
    part = F.pmod(F.xxhash64("src", "dst"), F.col("_parts"))

    def row(cell: Column, side: int, src: Column, dst: Column, a=None, b=None, rest=None) -> list[Column]:
        return [
            cell.alias("cell"),
            F.lit(side).cast("tinyint").alias("side"),
            src.cast("bigint").alias("src"),
            dst.cast("bigint").alias("dst"),
            (_empty(shapes[0]) if a is None else a).alias("_a"),
            (_empty(shapes[1]) if b is None else b).alias("_b"),
            *[(F.col(f.name) if rest else F.lit(None).cast(f.dataType)).alias(f.name) for f in more],
        ]

    def points(df: DataFrame, at: str, own: Column) -> DataFrame:
        held = F.struct(*[F.col(c) for c in df.columns if c != "id"]).alias("_held")
        some = df.where(F.col("id").isNotNull()).select("id", held).withColumn(at, block_of(F.col("id").cast("bigint"), own))
        return some.join(cells, at).select("*", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))

    nothing, cell = F.lit(None), number + F.col("_part")
    rows = (
        points(sources, "_i", blocks[0])
        .select(*row(cell, FIRST, F.col("id"), nothing, a=F.col("_held")))
        .unionByName(points(targets, "_j", blocks[1]).select(*row(cell, SECOND, nothing, F.col("id"), b=F.col("_held"))))
        .unionByName(placed.join(cells, ["_i", "_j"]).select(*row(number + part, PAIR, F.col("src"), F.col("dst"), rest=True)))
    )
    rows = rows.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int")).sortWithinPartitions("cell", "side")
    ids = [T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())]
    if measured:
        groups = [T.StructField(c, T.IntegerType()) for c in ("group_a", "group_b")]
        schema = T.StructType([*ids, *more, T.StructField("distance", T.DoubleType()), *groups])
    else:
        schema = T.StructType([*ids, *more, T.StructField("_a", shapes[0]), T.StructField("_b", shapes[1])])
    names = [f.name for f in more]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, a, b in _met(batches):
            for at in _matches(some, a, b, missing):
                for begin in range(0, len(at[0]), ROWS_OUT):
                    row, i, j = (x[begin : begin + ROWS_OUT] for x in at)
                    taken = some.select(["src", "dst", *names]).take(pa.array(row))
                    last = _measure(a, b, i, j, taken, missing) if measured else [a.rows.take(pa.array(i)), b.rows.take(pa.array(j))]
                    yield pa.RecordBatch.from_arrays([*taken.columns, *last], names=schema.names)

    return rows.mapInArrow(meet, schema)


def _empty(kind: T.DataType) -> Column:
    """A value of that type that holds nothing. Arrays are empty, not null: runs of null arrays take Spark's Arrow
    writer a time that grows with the square of their length."""
    if isinstance(kind, T.StructType):
        return F.struct(*[_empty(f.dataType).alias(f.name) for f in kind.fields])
    return (F.array() if isinstance(kind, T.ArrayType) else F.lit(None)).cast(kind)


class _Side:
    """How many rows one side has, and into how many blocks it is cut."""

    def __init__(self, points: DataFrame, block_rows: int | None, fewest: int):
        told = points.agg(F.count(F.lit(1)), F.max(vector_entries(points))).first()
        self.n, self.bytes = told[0], 12 * max(told[1] or 0, 1)
        fitting = math.ceil(self.n / (block_rows or max(SIDE_BYTES // self.bytes, 1)))
        self.blocks = max(fitting, min(fewest, math.ceil(self.n / FEWEST_ROWS)), 1)


def _joined(pairs, sources, targets, missing, kind, measured, first):
    """The same by two joins.

    The narrow pairs meet the rows of their `first` end first, so vectors travel with pairs in one
    shuffle only. Have it be the end results are kept for: neither join then has the partitioning of
    what follows, and Spark may split the partition of an id that is in most pairs.
    """
    held = lambda df, end, name: df.select(F.col("id").alias(end), F.struct(*[F.col(c) for c in df.columns if c != "id"]).alias(name))
    sides = {"src": held(sources, "src", "_a"), "dst": held(targets, "dst", "_b")}
    for end in (first, "dst" if first == "src" else "src"):
        pairs = pairs.join(sides[end], end, kind)
    a, b = found_or(missing, F.col("_a"), F.col("src")), found_or(missing, F.col("_b"), F.col("dst"))
    rest = [c for c in pairs.columns if c not in ("src", "dst", "_a", "_b")]
    if not measured:
        return pairs.select("src", "dst", *rest, a.alias("_a"), b.alias("_b"))
    features = [found_or(missing, F.col(f"{c}.features"), F.col(e)) for c, e in (("_a", "src"), ("_b", "dst"))]
    groups = [
        (F.col(f"{c}.group_id") if "group_id" in df.columns else F.lit(None)).cast("int").alias(g)
        for c, g, df in (("_a", "group_a", sources), ("_b", "group_b", targets))
    ]
    return pairs.select("src", "dst", *rest, SQUARED_EUCLIDEAN.column(*features).alias("distance"), *groups)


class _Block:
    """The rows of one side of a cell, by id."""

    def __init__(self, ids: pa.Array, rows: pa.StructArray):
        ids = ids.to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows.take(pa.array(order))
        self._vectors = None

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.searchsorted(self.ids, ids, side="left")
        return low, np.searchsorted(self.ids, ids, side="right") - low

    def vectors(self):
        """All vectors in the form distances are taken from, or False where one can't be used; it may be in no pair."""
        if self._vectors is None:
            column = self.rows.field("features")
            try:
                sparse = pa.types.is_struct(column.type)
                self._vectors = Rows.of(column) if sparse else np.ascontiguousarray(matrix(column).T)
            except ValueError:
                self._vectors = False
        return self._vectors


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Runs of pairs with the two blocks of their cell."""
    cell, held, blocks = None, None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cells, sides = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)]):
            if cells[begin] != cell:
                cell, held, blocks = cells[begin], [[], []], None
            some = batch.slice(begin, end - begin)
            if sides[begin] != PAIR:
                held[sides[begin]].append(some)
                continue
            if blocks is None:
                kinds = [(("src", "dst")[k], ("_a", "_b")[k]) for k in (FIRST, SECOND)]
                blocks = [_block(held[k], some, *kinds[k]) for k in (FIRST, SECOND)]
                held = None
            yield some, *blocks


def _block(held: list[pa.RecordBatch], some: pa.RecordBatch, id: str, rows: str) -> _Block:
    columns = [pa.concat_arrays([b.column(c) for b in held] or [some.column(c).slice(0, 0)]) for c in (id, rows)]
    return _Block(*columns)


def _matches(some: pa.RecordBatch, a: _Block, b: _Block, missing: str) -> Iterator[tuple]:
    """Places of a pair and of the rows of its ends, for every such three."""
    found = []
    present = np.ones(some.num_rows, bool)
    for name, block in (("src", a), ("dst", b)):
        column = some.column(name)
        low, count = block.found(pc.fill_null(column, 0).to_numpy(zero_copy_only=False))
        if column.null_count:
            count = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, count)
        if missing == "error" and not count.all():
            raise ValueError(f"no point with id {column[int(np.argmin(count))].as_py()}")
        present &= count > 0
        found.append((low, count))
    (low_a, count_a), (low_b, count_b) = found
    rows = np.flatnonzero(present)
    # Where ids repeat a pair may have many rows, so pairs are taken a few at a time.
    many = np.cumsum(count_a[rows] * count_b[rows]) // (16 * ROWS_OUT)
    for part in np.split(rows, np.flatnonzero(np.diff(many)) + 1):
        count = count_a[part] * count_b[part]
        row = np.repeat(part, count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        yield row, low_a[row] + nth // count_b[row], low_b[row] + nth % count_b[row]


def _measure(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray, taken: pa.RecordBatch, missing: str) -> list[pa.Array]:
    x, y = a.vectors(), b.vectors()
    if x is False or y is False or _length(x) != _length(y):
        left, right = a.rows.field("features").take(pa.array(i)), b.rows.field("features").take(pa.array(j))
        for name, column in (("src", left), ("dst", right)):
            if column.null_count and missing == "error":
                raise ValueError(f"no point with id {taken.column(name).filter(column.is_null())[0].as_py()}")
        distance = squares_of_rows(left, right)
    else:
        distance = pa.array(pair_squares(x, i, y, j) if isinstance(x, Rows) else fold_squares(x, y, i, j))
    groups = []
    for block, at in ((a, i), (b, j)):
        held = block.rows.type.get_field_index("group_id") >= 0
        groups.append(block.rows.field("group_id").take(pa.array(at)) if held else pa.nulls(len(at), pa.int32()))
    return [distance, *groups]


def _length(x) -> int:
    return x.size if isinstance(x, Rows) else len(x)
