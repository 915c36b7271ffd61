"""Which points need no more comparisons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Neighbours a list is asked for from which on its ids are packed before they are dealt out by node.
LONG_LIST = 256


def completed_ids(
    edges: DataFrame,
    viewed: DataFrame,
    k: int,
    max_comparisons: int,
    groups: int = 1,
    fill: bool = False,
    members: DataFrame | None = None,
) -> DataFrame:
    """Ids compared more than `max_comparisons` times; if that is not positive, ids with at least k
    distinct neighbours in every one of `groups` groups. With `fill` both are asked for.

    `members` (`id`, `group_id` of all points) lets a list be full that has all points of a group of fewer.
    """
    compared = viewed.where(F.col("viewed") > max_comparisons).select("id")
    if max_comparisons > 0 and not fill:
        return compared
    keys = ["src", "group_id"] if "group_id" in edges.columns else ["src"]
    if k >= LONG_LIST and isinstance(edges.schema["dst"].dataType, T.LongType):
        found = _found_packed(edges.select(*keys, "dst"), keys)
    else:
        found = edges.select(*keys, "dst").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_found"))
    needed = F.lit(groups)
    if members is not None:
        found, needed = _with_limits(found, members, k, groups)
    else:
        found = found.withColumn("_most", F.lit(k))
    full = found.where(F.col("_found") >= F.col("_most")).withColumn("_needed", needed)
    done = full.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("_groups"), F.max("_needed").alias("_needed"))
    done = done.where(F.col("_groups") >= F.col("_needed")).select("id")
    return done.join(compared, "id", "left_semi") if max_comparisons > 0 else done


def _found_packed(edges: DataFrame, keys: list[str]) -> DataFrame:
    """How many distinct neighbours each list has; what travels is a byte or two of each, not a row."""
    kinds = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _packed(batch, keys)

    def count(table: pa.Table) -> pa.Table:
        ids = [_unpacked(b) for b in table.column("ids").to_pylist()]
        n = len(np.unique(np.concatenate(ids))) + pc.any(table.column("unnamed")).as_py()
        return pa.table({c: table.column(c)[:1] for c in keys} | {"_found": pa.array([n], pa.int64())})

    parts = edges.mapInArrow(pack, f"{kinds}, ids binary, unnamed boolean")
    return parts.groupBy(*keys).applyInArrow(count, f"{kinds}, _found bigint")


def _packed(batch: pa.RecordBatch, keys: list[str]) -> pa.RecordBatch:
    """One row for each list of a batch: its keys, its distinct ids packed, and whether one is null."""
    code = np.zeros(batch.num_rows, np.int64)
    for c in keys:
        coded = batch.column(c).dictionary_encode(null_encoding="encode")
        code = code * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
    dst = batch.column("dst")
    known = dst.is_valid().to_numpy(zero_copy_only=False)
    ids = pc.fill_null(dst, 0).to_numpy(zero_copy_only=False)
    order = np.lexsort((ids, code))
    first = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
    ids, known = np.split(ids[order], first[1:]), np.split(known[order], first[1:])
    columns = [batch.column(c).take(pa.array(order[first])) for c in keys]
    columns += [pa.array([_pack(i[k]) for i, k in zip(ids, known)], pa.binary()), pa.array([not k.all() for k in known])]
    return pa.RecordBatch.from_arrays(columns, [*keys, "ids", "unnamed"])


def _pack(ids: np.ndarray) -> bytes:
    """Sorted ids as the first of them and gaps, in as few bytes as the widest needs."""
    if not len(ids):
        return b""
    # Differences wrap round where ids lie further apart than a number goes, and adding wraps them back.
    gaps = np.diff(ids).astype(np.uint64)
    gaps = gaps[gaps > 0]
    kind = next(t for t in ("<u1", "<u2", "<u4", "<u8") if gaps.max(initial=0) <= np.iinfo(t).max)
    return ids[:1].astype("<i8").tobytes() + kind[2:].encode() + gaps.astype(kind).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    gaps = np.frombuffer(raw, f"<u{raw[8:9].decode()}", offset=9).astype(np.uint64).view(np.int64)
    return np.cumsum(np.append(np.frombuffer(raw, "<i8", 1), gaps))


def _with_limits(found: DataFrame, members: DataFrame, k: int, groups: int):
    """Lists with `_most`, the neighbours they can have up to k; and how many lists of a node can have any."""
    sizes = members.groupBy(F.col("group_id").alias("_group")).agg(F.count(F.lit(1)).alias("_size"))
    named = members.select(F.col("id").alias("src"), F.col("group_id").alias("_own"))
    alone = F.when(F.col("_size") == 1, 1).otherwise(0)
    own = named.join(sizes, F.col("_own").eqNullSafe(F.col("_group"))).select("src", "_own", alone.alias("_alone"))
    keys = [c for c in found.columns if c != "_found"]
    sized = found.join(sizes, F.col("group_id").eqNullSafe(F.col("_group"))).drop("_group")
    most = F.col("_size") - F.when(F.col("_own").eqNullSafe(F.col("group_id")), 1).otherwise(0)
    told = sized.join(own, "src").select(*keys, "_found", "_alone", F.least(F.lit(k), most).alias("_most"))
    return told, F.lit(groups) - F.col("_alone")


def drop_completed(
    points: DataFrame, edges: DataFrame, viewed: DataFrame, k: int, max_comparisons: int, groups: int = 1
) -> DataFrame:
    """The points that still look for neighbours."""
    return points.join(completed_ids(edges, viewed, k, max_comparisons, groups), "id", "left_anti")
