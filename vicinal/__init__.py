"""Nearest-neighbour graphs over tables of numeric vectors, as Spark jobs."""

import sys

from pyspark import cloudpickle

from vicinal.config import KnnConfig
from vicinal.functions.distance import SQUARED_EUCLIDEAN, Distance
from vicinal.plans.graph import KnnResult, knn_graph

__all__ = ["Distance", "KnnConfig", "KnnResult", "SQUARED_EUCLIDEAN", "knn_graph"]

# What runs inside tasks travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
