"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.common import only, shuffle_width
from vicinal.operators.prefix import running_total
from vicinal.session import Scratch

# Fixed values of the contract: weights that repeat over sources in order, the share of all sizes that the mix
# has, and how often a source may be taken at most.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_EPOCHS = 2.0
#: Quality weights lie between this and 1.
LEAST_QUALITY = 0.05


def _measures(batches):
    """Words of each text and the share of its bytes that are letters, digits, blanks or beyond ASCII."""
    plain = np.zeros(256, bool)
    plain[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ", *range(128, 256)]] = True
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sizes, good = [], []
            for text in part.column("_text"):
                b = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                word = ~blank[b]
                sizes.append(int(np.count_nonzero(word[1:] & ~word[:-1])) + int(word[:1].sum()))
                good.append(float(plain[b].mean()) if len(b) else 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_id"),
                    part.column("_source"),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.maximum(good, LEAST_QUALITY)),
                ],
                ["_id", "_source", "size", "_quality"],
            )


def _running(batches):
    """Sizes summed up along a partition sorted by source and key, anew for each source."""
    part = TaskContext.get().partitionId()
    source, total = None, 0
    for batch in batches:
        sources = batch.column("_place").to_numpy()
        sizes = batch.column("size").to_numpy()
        sums = np.cumsum(sizes)
        first = np.append(0, np.flatnonzero(sources[1:] != sources[:-1]) + 1) if len(sources) else np.zeros(0, int)
        base = np.zeros(len(sizes), np.int64)
        for i, start in enumerate(first.tolist()):
            carried = total if i == 0 and sources[0] == source else 0
            end = first[i + 1] if i + 1 < len(first) else len(sizes)
            base[start:end] = carried - (sums[start] - sizes[start])
        before = sums + base - sizes
        if len(sizes):
            source, total = sources[-1], int(before[-1] + sizes[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(before), pa.array([part] * len(sizes), pa.int32())],
            [*batch.schema.names, "_before", "_part"],
        )


def targets(
    sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, scratch: Scratch | None = None
) -> DataFrame:
    """Add `_place` and `target` to a saved table of `_source`, `source_size`: one row per source.

    Sources are in order of code points, null last, and get `weights` in turn. A target is the source's part
    by weight of `share` times all sizes, but at most MOST_EPOCHS times its size; what is cut off is shared
    again among the others. Each round is one aggregate over the table and settles at least one more source,
    usually all but a few in the first rounds. Sources are numbered by ranges, so there may be as many as documents.
    """
    scratch = scratch or Scratch(sources.sparkSession)
    order = [F.col("_source").isNull(), F.col("_source")]
    numbered = scratch.save(running_total(sources, order, F.lit(1).cast("long"), "_place", scratch), "numbered-sources")
    turn = F.pmod(F.col("_place"), F.lit(len(weights)))
    weighted = numbered.withColumn(
        "_weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))
    )
    cap = F.col("source_size") * F.lit(MOST_EPOCHS)
    budget = float(weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    level = 0.0
    while True:
        capped = cap <= F.col("_weight") * F.lit(level)
        row = weighted.agg(
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~capped, F.col("_weight"))), F.lit(0.0)),
        ).first()
        if row[1] == 0:
            break
        higher = (budget - row[0]) / row[1]
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    target = F.least(cap, F.col("_weight") * F.lit(level))
    return weighted.select("_source", "source_size", "_place", target.alias("target"))


def mix(
    df: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Words the mix takes from each document: `id_col`, `size`, `source_size`, `target`, `taken`, `epochs`.

    `size` is the number of words, `target` the words wanted from the document's source (see `targets`). A
    target of n times the source's size and a rest takes all its documents n times, and the rest from its
    documents in order of their exponential keys -ln(u) / quality, where u is drawn from the id and `seed`
    and quality is the share of plain characters in the text. Documents go in whole: first all in that order
    that end within the rest, then of the others the one that fits best in what is still wanting, if any brings
    the sum nearer to it. `epochs` is how often the document is taken, `taken` that times its size.

    Rows are range-partitioned by source and key, so a large source is many ranges; sums run inside ranges
    and meet in a table of one row per range and source.

    Nulls: a null text has no words; null is a source of its own, after all others; null ids draw one key.
    Rows that repeat an id are taken each by itself and share a key. Empty texts take nothing. An empty
    table gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    work = only(df, _id=id_col, _text=text_col, _source=source_col)
    kinds = {f.name: f.dataType.simpleString() for f in work.schema}
    measured = scratch.save(
        work.mapInArrow(_measures, f"_id {kinds['_id']}, _source {kinds['_source']}, size long, _quality double"), "sizes"
    )
    sources = scratch.save(measured.groupBy("_source").agg(F.sum("size").alias("source_size")), "sources")
    wanted = scratch.save(targets(sources, weights, share, scratch), "targets")

    # 53 bits of a hash make a number above 0 and below 1.
    bits = F.shiftrightunsigned(F.xxhash64("_id", F.lit(seed)), 11)
    keyed = (
        measured.join(wanted, measured["_source"].eqNullSafe(wanted["_source"]))
        .drop("_source")
        .withColumn("_key", -F.log((bits + 0.5) / F.lit(2.0**53)) / F.col("_quality"))
        .drop("_quality")
    )
    width = shuffle_width(spark, 64.0 * measured.count())
    order = ["_place", "_key", "_id", "size"]
    ranged = keyed.repartitionByRange(width, *order).sortWithinPartitions(*order)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema)
    summed = scratch.save(ranged.mapInArrow(_running, f"{fields}, _before long, _part int"), "sums")

    in_order = Window.partitionBy("_place").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.save(
        summed.groupBy("_place", "_part")
        .agg(F.sum("size").alias("_sum"))
        .select("_place", "_part", F.coalesce(F.sum("_sum").over(in_order), F.lit(0)).alias("_offset")),
        "offsets",
    )

    def by_range(of_source: DataFrame) -> DataFrame:
        """A row per source as a row per source and range, so that documents never meet by source alone."""
        return offsets.select("_place", "_part").join(of_source, "_place")

    epochs = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rest = F.col("target") - epochs * F.col("source_size")
    placed = summed.join(offsets, ["_place", "_part"]).select(
        "_place",
        "_part",
        "_id",
        "size",
        "source_size",
        "target",
        epochs.alias("_epochs"),
        rest.alias("_rest"),
        (F.col("_offset") + F.col("_before")).alias("_start"),
    )
    left = placed.where(F.col("_start") + F.col("size") > F.col("_rest"))
    gaps = left.groupBy("_place").agg((F.first("_rest") - F.min("_start")).alias("_gap"))
    misfit = F.abs(F.col("size") - F.col("_gap"))
    last = (
        left.join(by_range(gaps), ["_place", "_part"])
        .where(misfit < F.col("_gap"))
        .groupBy("_place")
        .agg(F.min(F.struct(misfit, F.col("_start"))).getField("_start").alias("_last"))
    )
    taken = (F.col("_start") + F.col("size") <= F.col("_rest")) | (
        F.col("_start").eqNullSafe(F.col("_last")) & (F.col("size") > 0)
    )
    times = F.col("_epochs") + F.when(taken, 1).otherwise(0)
    return placed.join(by_range(last), ["_place", "_part"], "left").select(
        F.col("_id").alias(id_col),
        "size",
        "source_size",
        "target",
        (times * F.col("size")).cast("long").alias("taken"),
        times.cast("int").alias("epochs"),
    )
