"""Written tables in the folder all executors share.

Loops cut their lineage by writing a small table and reading it back, so a lost
executor costs a re-read and never a replay of earlier iterations. The folder is
the cluster's ``spark.checkpoint.dir``; only a local session without one gets a
temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="adloom-")
    return _local_roots[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written to yet."""
    return f"{shared_dir(spark).rstrip('/')}/adloom/{name}-{uuid.uuid4().hex}"


def materialize(
    df: DataFrame, name: str, partition_by: tuple[str, ...] = (), lasting: bool = False
) -> DataFrame:
    """Write ``df`` once and return a frame that reads the written table.

    A ``lasting`` table stays when the ``scratch`` block that it is written in ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    written = _written.get()
    if written is not None and not lasting:
        written.append(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, name: str, key: str, buckets: int, partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """Write ``df`` as a table bucketed and sorted by ``key``, and return it with its name.

    Reads of it are laid out by ``key`` already: grouping or joining on it needs no shuffle.
    The files lie in the shared folder; ``drop_bucketed`` removes them and the catalog's entry.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = f"adloom_{name}_{path[-32:]}".replace("-", "_")
    writer = df.repartition(buckets, key).write.format("parquet").option("path", path)
    writer.partitionBy(*partition_by).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table), table


def drop_bucketed(table: DataFrame, name: str) -> None:
    release(table)
    table.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are written inside the block, but for ``lasting`` ones, when it ends.

    Results that leave the block must be rows, or tables written as ``lasting``.
    """
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(table: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and nothing will read again."""
    ours = shared_dir(table.sparkSession).rstrip("/").split(":", 1)[-1].lstrip("/") + "/adloom/"
    folders = set()
    for file in table.inputFiles():
        before, found, inside = file.partition(ours)
        if not found:
            raise ValueError(f"{file} is in no written table of this engine")
        folders.add(before + found + inside.split("/")[0])  # a partitioned table goes with all its folders
    for folder in folders:
        _delete(table.sparkSession, folder)
