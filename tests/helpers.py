"""Small brute-force counterparts and readers of results."""

import numpy as np


def fold(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += (x - y) * (x - y)
    return total


def brute(vectors, k, ids=None, groups=None):
    """{(src, group): [(distance, dst), ...]} with ties to the smaller id."""
    vectors = np.asarray(vectors, dtype=float)
    ids = list(range(len(vectors))) if ids is None else [int(i) for i in ids]
    groups = [0] * len(ids) if groups is None else groups
    found = {}
    for i, src in enumerate(ids):
        for j, dst in enumerate(ids):
            if i != j:
                found.setdefault((src, int(groups[j])), []).append((fold(vectors[i], vectors[j]), dst))
    return {key: sorted(values)[:k] for key, values in found.items()}


def lists(edges):
    """The same shape from an edge table, checking ranks on the way."""
    grouped = "group_id" in edges.columns
    found = {}
    for row in edges.collect():
        key = (row["src"], row["group_id"] if grouped else 0)
        found.setdefault(key, []).append((row["distance"], row["dst"], row["rank"]))
    for values in found.values():
        values.sort()
        assert [v[2] for v in values] == list(range(1, len(values) + 1))
    return {key: [v[:2] for v in values] for key, values in found.items()}


def neighbor_ids(edges):
    found = {}
    for row in edges.collect():
        found.setdefault(row["src"], []).append((row["distance"], row["dst"]))
    return {src: [dst for _, dst in sorted(values)] for src, values in found.items()}
