"""Building a graph from a point table, exactly or by hashing at a growing radius."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.config import KnnConfig
from vicinal.functions.distance import SQUARED_EUCLIDEAN, Distance
from vicinal.operators.buckets import (
    bucket_tasks,
    bucket_viewed,
    bucketize,
    knn_in_buckets,
    split_buckets,
)
from vicinal.operators.copies import copy_map, distinct_vectors, expand_copies
from vicinal.operators.exact import knn_exact
from vicinal.operators.hashing import HashFamily, hash_projected, project_points
from vicinal.operators.retire import completed_ids
from vicinal.operators.stragglers import sized_reverse_lists, straggler_exhaustive
from vicinal.operators.topk import merge_counters, merge_graphs
from vicinal.operators.tuning import choose_parameters, with_parameters
from vicinal.session import Scratch
from vicinal.sources.points import PointStats, describe, kernel_columns


@dataclass
class KnnResult:
    """A graph, each node's comparisons, the settings used and one record per step.

    `buckets` holds the members of each round's buckets, for `bucket_histogram` and the like; `lists` is how
    many lists of k there are to fill, one for each point and group.
    """

    edges: DataFrame
    viewed: DataFrame | None
    config: KnnConfig
    steps: list[dict] = field(default_factory=list)
    comparisons: int = 0
    all_pairs: int = 0
    buckets: list[DataFrame] = field(default_factory=list)
    lists: int = 0

    def short_lists(self) -> int:
        """Lists with fewer than k neighbours, empty ones among them."""
        keys = ["src", "group_id"] if "group_id" in self.edges.columns else ["src"]
        full = self.edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.config.k)
        return self.lists - full.count()

    @property
    def relative_cost(self) -> float:
        """Comparisons against those of brute force."""
        return self.comparisons / self.all_pairs if self.all_pairs else 0.0


def knn_graph(
    points: DataFrame,
    config: KnnConfig = KnnConfig(),
    group_col: str | None = None,
    distance: Distance = SQUARED_EUCLIDEAN,
) -> KnnResult:
    """The k-nearest-neighbour graph of a point table; with `group_col`, k from each group of neighbours."""
    stats = describe(points)
    if not config.collapse_copies:
        return _build(points, stats, config, group_col, distance)
    if distance is not SQUARED_EUCLIDEAN:
        raise ValueError("collapse_copies needs squared distances")
    scratch = Scratch(points.sparkSession)
    reps, first = distinct_vectors(points, config.k, group_col)
    reps = scratch.save(reps, "distinct-vectors")
    built = _build(reps, describe(reps), config, group_col, distance)
    copies = scratch.save(copy_map(points, reps, group_col), "copies")
    edges = expand_copies(built.edges, first, copies, config.k, group_col)
    viewed = None
    if built.viewed is not None:
        viewed = copies.join(built.viewed.withColumnRenamed("id", "rep"), "rep").select("id", "viewed")
    return replace(built, edges=edges, viewed=viewed)


def _build(points, stats, config, group_col, distance) -> KnnResult:
    if config.method == "brute":
        pairs = stats.n * (stats.n - 1) // 2
        edges = knn_exact(points, config.k, group_col, distance=distance, stats=stats)
        return KnnResult(edges, None, config, comparisons=pairs, all_pairs=pairs)
    return _hashed(points, stats, config, group_col, distance)


class _Log:
    """The graph as a log: what retired points ended with, and the state of those that still look.

    A round writes what it found for the points it touched, merged with their state, and which of them retire; what
    retired points have is read where it was written. So a round writes as much as there are points left.
    """

    def __init__(self, scratch: Scratch, k: int):
        self.scratch, self.k = scratch, k
        self.edges: DataFrame | None = None
        self.viewed: DataFrame | None = None
        self.closed: list[tuple[DataFrame, DataFrame]] = []

    def add(self, found: DataFrame, viewed: DataFrame, turn: int) -> None:
        self.edges = self.scratch.save(merge_graphs([self.edges, found], self.k), f"edges{turn}")
        self.viewed = self.scratch.save(merge_counters([self.viewed, viewed]), f"viewed{turn}")

    def retire(self, done: DataFrame) -> None:
        nodes = done.select(F.col("id").alias("src"))
        self.closed.append((self.edges.join(nodes, "src", "left_semi"), self.viewed.join(done, "id", "left_semi")))
        self.edges, self.viewed = self.edges.join(nodes, "src", "left_anti"), self.viewed.join(done, "id", "left_anti")

    def compact(self) -> tuple[DataFrame, DataFrame]:
        """All edges and counters, written once."""
        edges, viewed = self.edges, self.viewed
        columns = edges.columns
        for old_edges, old_viewed in self.closed:
            edges, viewed = edges.unionByName(old_edges.select(columns)), viewed.unionByName(old_viewed)
        return self.scratch.save(edges, "edges"), self.scratch.save(viewed, "viewed")


def _hashed(
    points: DataFrame, stats: PointStats, config: KnnConfig, group_col: str | None, distance: Distance
) -> KnnResult:
    """Hash the remaining points, compare inside buckets, retire the well-compared, double the radius.

    Points are projected once and written with their projections, which give the keys of every radius.
    """
    n, k = stats.n, config.k
    if n <= 1:
        return KnnResult(knn_exact(points, k, group_col, distance=distance, stats=stats), None, config)
    scratch = Scratch(points.sparkSession)
    config = with_parameters(config, choose_parameters(points, n, stats.dim, config, scratch))
    family = HashFamily(stats.dim, config.key_length, config.tables, config.seed, share_tables=config.share_tables)
    groups = points.select(group_col).distinct().count() if group_col else 1
    result = KnnResult(points, None, config, all_pairs=n * (n - 1) // 2, lists=n * groups)

    log = _Log(scratch, k)
    columns = points.columns
    stored, stored_count = scratch.save(project_points(points, family), "projected"), n
    remaining, left, retired = stored, n, []
    radius, buckets_in_a_table = config.radius, 2
    turn = 0

    members = kernel_columns(points, group_col).select("id", "group_id") if config.fill_lists and group_col else None

    def completed(edges, viewed):
        return completed_ids(edges, viewed, min(k, n - 1), config.max_comparisons, groups, config.fill_lists, members)

    while (buckets_in_a_table > 1 or left > k) and left > 1 and (config.max_rounds is None or turn < config.max_rounds):
        hashed = hash_projected(remaining, family, radius)
        buckets = scratch.save(bucketize(hashed, distinct=config.share_tables), f"buckets{turn}")
        seen = _bucket_totals(buckets)
        if seen["rows"] and config.split_above:
            buckets, seen = _split(points, buckets, family, radius, config, scratch, seen)
        stuck = False
        if seen["rows"]:
            buckets_in_a_table = seen["buckets_in_a_table"]
            result.buckets.append(buckets)
            result.comparisons += seen["comparisons"]
            tasks = bucket_tasks(points, seen["rows"], seen["comparisons"], stats.entries)
            log.add(knn_in_buckets(stored, buckets, k, group_col, distance=distance, tasks=tasks), bucket_viewed(buckets), turn)
            done = scratch.save(completed(log.edges, log.viewed), f"done{turn}")
            gone = done.count()
            # All that are left have met, and only full lists let them go: wider buckets bring nothing new.
            stuck = not gone and seen["largest"] >= left and (config.fill_lists or config.max_comparisons <= 0)
            if gone:
                log.retire(done)
                left -= gone
                retired.append(done)
                remaining = stored.join(reduce(DataFrame.unionByName, retired), "id", "left_anti")
                if 0 < left <= stored_count / 2:
                    # Halving at least each time, these tables add up to no more than the points.
                    stored = remaining = scratch.save(remaining, f"remaining{turn}")
                    stored_count, retired = left, []
        result.steps.append({"step": "round", "radius": radius, **seen, "left": left})
        radius *= 2
        turn += 1
        if stuck:
            break

    if log.edges is None:
        result.edges = knn_exact(points, k, group_col, distance=distance, stats=stats)
        result.comparisons = result.all_pairs
        return result
    edges, viewed = log.compact()
    if left:
        edges, viewed, remaining, left = _from_holders(
            points, remaining.select(columns), left, edges, viewed, config, group_col, completed, distance, scratch, result, stats.entries
        )
    if left:
        nodes = edges.select(F.col("src").alias("id")).union(remaining.select("id")).distinct().count()
        result.comparisons += left * nodes
        result.steps.append({"step": "exhaustive", "comparisons": left * nodes, "left": left})
        found = straggler_exhaustive(points, remaining, edges, k, group_col, distance, each_other=True)
        edges = scratch.save(merge_graphs([edges, found], k), "edges-exhaustive")
    result.edges, result.viewed = edges, viewed
    return result


def _from_holders(
    points, remaining, left, edges, viewed, config, group_col, completed, distance, scratch, result, entries
):
    """Compare each straggler with the nodes whose lists hold it, and with those lists."""
    lists = scratch.save(sized_reverse_lists(edges, remaining), "holder-lists")
    totals = lists.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("twice")
    ).first()
    if totals["rows"]:
        # Work is counted as the square of each list's size, as users of the measure expect.
        work = totals["rows"] + totals["twice"]
        result.comparisons += work
        tasks = bucket_tasks(points, totals["rows"], work, entries)
        found = knn_in_buckets(points, lists, config.k, group_col, ["list_id"], distance, tasks=tasks)
        edges = scratch.save(merge_graphs([edges, found], config.k), "edges-holders")
        viewed = scratch.save(merge_counters([viewed, bucket_viewed(lists)]), "viewed-holders")
        done = completed(edges, viewed)
        remaining = scratch.save(remaining.join(done, "id", "left_anti"), "remaining-holders")
        left = remaining.count()
        result.steps.append({"step": "holders", "comparisons": work, "left": left})
    return edges, viewed, remaining, left


def _bucket_totals(buckets: DataFrame) -> dict:
    """Bucket counts and cost in one pass: a bucket of n has n rows, so rows / n counts buckets."""
    sizes = buckets.groupBy("table_id", "size").agg(F.expr("count(*) div size").alias("buckets"))
    tables = sizes.groupBy("table_id").agg(
        F.sum("buckets").alias("buckets"),
        F.sum(F.col("buckets") * F.col("size")).alias("rows"),
        F.sum(F.expr("buckets * size * (size - 1) div 2")).alias("comparisons"),
        F.max("size").alias("largest"),
    )
    row = tables.agg(
        F.sum("rows"), F.sum("buckets"), F.max("buckets"), F.sum("comparisons"), F.max("largest")
    ).first()
    return dict(zip(("rows", "buckets", "buckets_in_a_table", "comparisons", "largest"), [v or 0 for v in row]))


def _split(points, buckets, family, radius, config, scratch, seen):
    """Split buckets of `split_above` or more, at ever smaller radii, until none is left or the largest stays.

    Copies of one vector can't be split; `unsplit` in the step's record says how large a bucket was left.
    """
    turn, largest = 0, None
    while seen["rows"] and seen["largest"] >= config.split_above and (largest is None or seen["largest"] < largest):
        largest = seen["largest"]
        radius /= config.split_step
        parts = split_buckets(points, buckets, family, radius, config.split_above)
        buckets = scratch.save(parts, f"split{turn}")
        seen = _bucket_totals(buckets)
        turn += 1
    if seen["largest"] >= config.split_above:
        seen = {**seen, "unsplit": seen["largest"]}
    return buckets, seen
