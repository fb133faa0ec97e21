"""Shared storage for intermediate results.

Iterative jobs (rule fixpoints, repairs, dense ids) write each step as Parquet below the folder the
cluster names in ``spark.checkpoint.dir``.  A written step cuts the lineage, survives the loss of any
executor, keeps column pruning, and gives the next step real file sizes to plan with.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach; made here only for a local session that names none."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="trivane-")
    spark.sparkContext.setCheckpointDir(made)
    return made


_SCOPE = threading.local()


def new_step_dir(spark: SparkSession, label: str) -> str:
    root = getattr(_SCOPE, "folder", None) or shared_dir(spark)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Remove a folder of written steps, wherever it is; it may be gone already."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def passing_steps(spark: SparkSession) -> Iterator[None]:
    """Steps written by this thread inside go away at the end, so a job that runs for ever leaves none behind.

    Nothing that is read later may depend on them: write it elsewhere before the end.
    """
    outer = getattr(_SCOPE, "folder", None)
    _SCOPE.folder = new_step_dir(spark, "passing")
    try:
        yield
    finally:
        folder, _SCOPE.folder = _SCOPE.folder, outer
        remove_dir(spark, folder)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared storage and return it as a plain file scan."""
    spark = df.sparkSession
    path = new_step_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than one row beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


class StepLog:
    """The written steps of an iteration, readable as one file scan over any run of them.

    One scan keeps the plan of every round the same size and shape, however many rounds there are.
    """

    def __init__(self, like: DataFrame, label: str) -> None:
        self._spark = like.sparkSession
        self._schema = like.schema
        self._root = new_step_dir(self._spark, label)
        self._paths: list[str] = []

    def __len__(self) -> int:
        return len(self._paths)

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self._spark.createDataFrame([], self._schema)
        return self._spark.read.schema(self._schema).parquet(*paths)

    def append(self, df: DataFrame) -> DataFrame:
        """Write one step and return it."""
        path = f"{self._root}/step-{len(self._paths)}"
        df.select(*self._schema.names).write.parquet(path)
        self._paths.append(path)
        return self._read([path])

    def drop_last(self) -> None:
        """Forget an empty last step."""
        self._paths.pop()

    def all(self) -> DataFrame:
        return self._read(self._paths)

    def before_last(self) -> DataFrame:
        return self._read(self._paths[:-1])
