"""Where result tables go: written aside, checked, and only then put in place.

A named table is an external Parquet table whose location, or the location of one of its days, points at the folder of
the last good write. Putting a write in place is one change of that pointer in the catalog, so readers see the old rows
or the new ones and never a part, and a write that is lost on the way leaves the table as it was. Folders of earlier
writes stay, for readers that are under way, until `unused_writes` names them to the retention job.

A plain folder has no catalog to point with. Its days are replaced by Spark's dynamic partition overwrite, from a copy
that was written aside and checked, so days that are not in the result are not touched. Without days the folder is
overwritten from that copy, which remains if the overwriting is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.staging import new_path


class WriteCheckError(ValueError):
    """The written rows are not what the table needs; the table is as it was."""


def _checked_copy(df: DataFrame, path: str, day: str | None, keys: Sequence[str], rows: int | None) -> DataFrame:
    """Writes `df` to a new folder and reads it back. Lost, repeated or keyless rows are an error."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(day) if day else writer).parquet(path)
    copy = df.sparkSession.read.schema(df.schema).parquet(path)
    names = [*([day] if day else []), *keys]
    if not names and rows is None:
        return copy
    # One pass for all checks.
    groups = copy.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    missing = [F.sum(F.when(F.col(f"`{n}`").isNull(), F.col("_n")).otherwise(0)) for n in names]
    found, most, *missing = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.max("_n"), *missing).first()
    if rows is not None and found != rows:
        raise WriteCheckError(f"{found} rows were written of {rows}")
    lacking = [name for name, n in zip(names, missing) if n]
    if lacking:
        raise WriteCheckError(f"{', '.join(lacking)} of a row is missing")
    if keys and (most or 0) > 1:
        raise WriteCheckError(f"{', '.join(keys)} of a row is repeated")
    return copy


def _literal(value) -> str:
    return "'{}'".format(str(value).replace("\\", "\\\\").replace("'", "\\'"))


def _columns(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _root(spark: SparkSession, table: str, root: str | None) -> str:
    return f"{(root or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{table.replace('.', '/')}"


def write_table(
    df: DataFrame,
    target: str,
    overwrite: bool = True,
    day: str | None = None,
    keys: Sequence[str] = (),
    root: str | None = None,
    rows: int | None = None,
) -> None:
    """Replaces a named table, or a folder if `target` has a slash, by the rows of `df`; without `overwrite` it must be new.

    With `day` the table is partitioned by that column, and only the days that `df` has are replaced. `keys` name
    columns that must be present and unique (within the day), and `rows` says how many rows there must be. If a check fails the target is as it was. A named
    table's files go below `root`, by default the warehouse. The result may be read from the target itself.
    """
    spark = df.sparkSession
    if "/" in target:
        copy = _checked_copy(df, new_path(spark, "aside"), day, keys, rows)
        writer = copy.write.mode("overwrite" if overwrite else "errorifexists")
        (writer.option("partitionOverwriteMode", "dynamic").partitionBy(day) if day else writer).parquet(target)
        return
    if not overwrite and spark.catalog.tableExists(target):
        raise ValueError(f"{target} already exists")
    path = f"{_root(spark, target, root)}/write-{uuid.uuid4().hex}"
    ordered = df.select(*[c for c in df.columns if c != day], *([day] if day else []))
    copy = _checked_copy(ordered, path, day, keys, rows)
    if not spark.catalog.tableExists(target):
        # The table begins as an empty folder, so a loss before the first write is in place leaves an empty table.
        begin = path if day is None else f"{_root(spark, target, root)}/days"
        by = f" partitioned by (`{day}`)" if day else ""
        spark.sql(f"create table {target} ({_columns(ordered.schema)}) using parquet{by} location {_literal(begin)}")
    elif day is None:
        spark.sql(f"alter table {target} set location {_literal(path)}")
    if day:
        # The days of one write: one row for each.
        for (value,) in copy.select(day).distinct().orderBy(day).collect():
            of_day = f"partition (`{day}` = {_literal(value)})"
            place = _literal(f"{path}/{day}={value}")
            spark.sql(f"alter table {target} add if not exists {of_day} location {place}")
            spark.sql(f"alter table {target} {of_day} set location {place}")
    spark.catalog.refreshTable(target)


def read_table(spark: SparkSession, target: str) -> DataFrame:
    """The rows that `write_table` put in place."""
    return spark.read.parquet(target) if "/" in target else spark.read.table(target)


def places(spark: SparkSession, table: str) -> list[str]:
    """The folders that a named table points at, one for each day of a partitioned table."""

    def location(detail: str) -> str:
        rows = spark.sql(f"describe table extended {table} {detail}").collect()
        return next(r["data_type"] for r in rows if r["col_name"] == "Location")

    if not any(c.isPartition for c in spark.catalog.listColumns(table)):
        return [location("")]
    days = [r["partition"].split("=", 1) for r in spark.sql(f"show partitions {table}").collect()]
    return [location(f"partition (`{name}` = {_literal(value)})") for name, value in days]


def unused_writes(spark: SparkSession, table: str, written: Sequence[str]) -> list[str]:
    """Those of the folders `written` (paths of earlier writes) that the table does not point at or into."""
    used = [p.removeprefix("file:").rstrip("/") for p in places(spark, table)]
    return [w for w in written if not any(f"{u}/".startswith(f"{w.removeprefix('file:').rstrip('/')}/") for u in used)]
