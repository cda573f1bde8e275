"""Written intermediate tables.

A staged table cuts the lineage behind a table that several later steps read. It lives in
the folder the cluster names in `spark.checkpoint.dir`, which every executor can reach, so
a lost executor costs a re-read and not a re-computation. Being Parquet it also keeps
column pruning, filter pushdown and real size statistics for the joins that follow.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[DataFrame, str], DataFrame]


def shared_folder(spark: SparkSession) -> str:
    """Folder for staged tables: the session's setting, or a scratch one in local mode only."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write the table once and continue from the written copy."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(key: str, buckets: int | None = None) -> Stage:
    """A way to stage that deals the rows into buckets of `key`, as many as shuffle partitions if not told otherwise.

    Tables dealt alike join, and are grouped, by that key without an exchange. It is for tables of about one row for each
    key: all rows of a key are in one bucket. The catalog names the table only until it is opened; its files are external
    and stay, in the folder of the other staged tables.
    """

    def keep(df: DataFrame, name: str) -> DataFrame:
        spark = df.sparkSession
        number = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"{name}_{uuid.uuid4().hex}"
        dealt = df.repartition(number, key).write.format("parquet").bucketBy(number, key)
        dealt.option("path", new_path(spark, name)).saveAsTable(table)
        copy = spark.read.table(table)
        spark.sql(f"drop table {table}")
        return copy

    return keep


def stage_together(spark: SparkSession, keep: Stage, **tables: DataFrame | Callable[[], DataFrame]) -> list[DataFrame]:
    """Stage independent tables at the same time, so that one job's tail does not idle the cluster.

    A table may be a function that makes it, where making it stages tables of its own.
    """

    def one(table: DataFrame | Callable[[], DataFrame], name: str) -> DataFrame:
        return keep(table() if callable(table) else table, name)

    with ThreadPoolExecutor(len(tables)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(one), table, name) for name, table in tables.items()]
        return [job.result() for job in started]
