"""Near-duplicates by SimHash, with a pigeonring filter before the full comparison."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import arrow_type, only, rows_of, sql_type
from vicinal.llm.components import components
from vicinal.session import Scratch

#: Words turned into shingles at a time.
WORDS_HELD = 1 << 18


def _shingles(text: str, words: int):
    """Lists of shingles as bytes; white space is ASCII, as bytes.split() has it."""
    tokens = text.encode().lower().split()
    if 0 < len(tokens) < words:
        yield [b" ".join(tokens)]
        return
    for at in range(0, len(tokens) - words + 1, WORDS_HELD):
        part = tokens[at : at + WORDS_HELD + words - 1]
        joined = b" ".join(part)
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        yield [joined[a:b] for a, b in zip(starts[: len(part) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(text: str, words: int = 4) -> int:
    """Bits that more than half of the shingles' 64-bit hashes (XXH64, seed 42) have set."""
    total, n = np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_intdigest
    for shingles in _shingles(text, words):
        hashes = np.array([digest(s, 42) for s in shingles], np.uint64)
        n += len(hashes)
        for at in range(0, len(hashes), 1 << 14):
            bits = np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.sum(axis=0, dtype=np.int64)
    return int((1 << np.flatnonzero(2 * total > n).astype(object)).sum()) if n else 0


def fingerprints(df: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`_id` and `_print`, the fingerprint as a signed 64-bit number, of every whole text; null counts as empty."""
    source = only(df, _id=id_col, _text=text_col)
    kind = arrow_type(source, "_id")

    def run(batches):
        gc.disable()
        for batch in batches:
            prints = [fingerprint(t or "", words) for (t,) in rows_of([batch], "_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").cast(kind), pa.array(np.array(prints, np.uint64).view(np.int64))], ["_id", "_print"]
            )

    return source.mapInArrow(run, f"_id {sql_type(source, '_id')}, _print long")


def _edges(count: int) -> list[int]:
    """Where `count` segments of the 64 bits begin, and 64."""
    return [round(i * 64 / count) for i in range(count + 1)]


def _segment(column: Column, edges: list[int], i: int) -> Column:
    """Bits of segment `i`, counted round the ring."""
    i %= len(edges) - 1
    low, high = edges[i], edges[i + 1]
    return F.shiftrightunsigned(column, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def links(prints: DataFrame, bits: int, scratch: Scratch) -> DataFrame:
    """`a`, `b`: edges that connect exactly the fingerprints (column `_print`, distinct) that chains of links connect.

    A link is a pair at `bits` or fewer differing bits. The 64 bits lie in a ring of bits + 1 segments. For
    a link there is a segment to start from such that the first l segments together differ in at most
    l * bits / (bits + 1) bits, for every l: none in the first, one in the first two, two in the first three.
    The first two conditions are the key of an equi-join: one side also appears under the keys with one bit
    of the second segment turned, if that segment's parity is odd (so that a pair one bit apart meets once).
    The other lengths and the full distance are checked inside the join.

    Fingerprints that share a key with many others are first linked to the key's smallest one; the join then
    leaves out pairs that those links connect already. So a dense group gives as many edges as it has members.
    """
    count = bits + 1
    edges = _edges(count)
    ring = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(i).alias("start"),
                    _segment(F.col("_print"), edges, i).alias("same"),
                    _segment(F.col("_print"), edges, i + 1).alias("next"),
                )
                for i in range(count)
            )
        )
    )
    far = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    keyed = prints.select("_print", ring.alias("r")).select("_print", "r.start", "r.same", "r.next")

    first = keyed.groupBy("start", "same", "next").agg(F.min("_print").alias("_least"), F.count("*").alias("_n"))
    stars = (
        keyed.join(first.where("_n > 1"), ["start", "same", "next"])
        .where((F.col("_print") != F.col("_least")) & (far(F.col("_print"), F.col("_least")) <= bits))
        .select(F.col("_least").alias("a"), F.col("_print").alias("b"))
    )
    stars = scratch.save(stars.distinct(), "stars")
    roots = components(stars, scratch)
    grouped = scratch.save(
        prints.join(roots.select(F.col("node").alias("_print"), "root"), "_print", "left").select(
            "_print", F.coalesce("root", "_print").alias("_group")
        ),
        "grouped",
    )

    keyed = grouped.select("_print", "_group", ring.alias("r")).select("_print", "_group", "r.start", "r.same", "r.next")
    widths = [edges[(i + 1) % count + 1] - edges[(i + 1) % count] for i in range(count)]
    width = F.element_at(F.array(*map(F.lit, widths)), F.col("start") + 1)
    turned = F.when(
        F.bit_count("next") % 2 == 1,
        F.concat(
            F.array(F.col("next")),
            F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.col("next").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))),
        ),
    ).otherwise(F.array(F.col("next")))
    left = keyed.select(
        F.col("_print").alias("a"), F.col("_group").alias("ga"), "start", "same", F.col("next").alias("own"), F.explode(turned).alias("next")
    )
    right = keyed.select(F.col("_print").alias("b"), F.col("_group").alias("gb"), "start", "same", "next")
    a, b = F.col("a"), F.col("b")
    chain = F.lit(True)
    for length in range(3, count):
        so_far = [
            F.when(
                F.col("start") == i,
                sum((far(_segment(a, edges, i + k), _segment(b, edges, i + k)) for k in range(1, length)), F.lit(0)),
            )
            for i in range(count)
        ]
        chain = chain & (F.coalesce(*so_far) <= length * bits // count)
    joined = left.join(right, ["start", "same", "next"]).where(
        (F.col("ga") != F.col("gb"))
        # Equal segments meet from both sides: once is enough.
        & ((left["own"] != left["next"]) | (a < b))
        & chain
        & (far(a, b) <= bits)
    )
    return stars.unionByName(joined.select("a", "b"))


def simhash_groups(
    df: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`id_col`, `fingerprint` (16 hex digits) and `component_id`, the smallest id reachable by links.

    Documents with equal fingerprints are one node, however many; see `links` for the others. A text without
    words has the fingerprint zero and is linked like any other; a text of fewer words than a shingle has is
    one shingle. Null ids come after all others, so they are a component's id only where all are null. Rows
    that repeat an id are each returned. An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    documents = scratch.save(fingerprints(df, words, id_col, text_col), "prints")
    nodes = scratch.save(documents.groupBy("_print").agg(F.min("_id").alias("_first")), "nodes")
    roots = components(links(nodes.select("_print"), bits, scratch), scratch)
    owned = nodes.join(roots.select(F.col("node").alias("_print"), "root"), "_print", "left").select(
        "_print", "_first", F.coalesce("root", "_print").alias("_root")
    )
    owned = scratch.save(owned, "owned")
    least = owned.groupBy("_root").agg(F.min("_first").alias("_least"))
    named = scratch.save(owned.join(least, "_root").select("_print", "_least"), "named")
    return documents.join(named, "_print").select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"),
        F.col("_least").alias("component_id"),
    )
