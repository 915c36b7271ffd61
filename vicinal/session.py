"""Tables that cut lineage, kept in the folder the cluster names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


LARGE_ROWS = {
    "parquet.block.size": str(16 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.block.size.row.check.max": "1",
    "parquet.page.size.row.check.min": "1",
    "parquet.page.size.row.check.max": "1",
}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names for checkpoints."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
    return root.rstrip("/")


def local_checkpoints(spark: SparkSession) -> None:
    """For tests and trials on one machine: name a temporary folder if the session names none."""
    set_already = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_already and spark.sparkContext.master.startswith("local["):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vicinal-"))


class Scratch:
    """Intermediate tables of one job.

    A written table is computed once, survives lost executors, gives later plans a short lineage,
    and tells the optimizer its true size.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/vicinal-{uuid.uuid4().hex}"
        self._count = 0

    def new_path(self, name: str) -> str:
        self._count += 1
        return f"{self.path}/{self._count:04d}-{name}"

    def save(self, df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
        """`large_rows`: rows of megabytes, which Parquet's writer counts one by one and lets go in small groups.
        By default it looks at its size once in a hundred rows, and a reader takes a group's rows together."""
        path = self.new_path(name)
        df.write.mode("errorifexists").options(**(LARGE_ROWS if large_rows else {})).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def free_path(spark: SparkSession, path: str) -> str:
    """`path`, or `path-1`, `path-2`, ... if it is taken."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    candidate, i = path, 0
    while files.exists(jvm.org.apache.hadoop.fs.Path(candidate)):
        i += 1
        candidate = f"{path}-{i}"
    return candidate


def tasks_for(spark: SparkSession, byte_count: float, work: float = 0.0) -> int:
    """Shuffle width for `byte_count` bytes and `work` multiply-adds: small enough tasks, enough of them."""
    by_size = int(byte_count / (128 << 20)) + 1
    by_work = int(work / 2e10) + 1
    return max(spark.sparkContext.defaultParallelism, by_size, by_work)
