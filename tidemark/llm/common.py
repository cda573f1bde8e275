"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows and UTF-8 bytes of text that a task handles at a time: texts are large, so an Arrow batch is cut again.
SLICE_ROWS = 512
SLICE_BYTES = 4_000_000
# Rows at a time where a text is expanded to many times its size (a number for each letter, a string for each word).
SMALL_SLICE_ROWS = 128


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return (F.crc32(F.col(key).cast("string").cast("binary")) % modulus).cast("int")


def slices(
    batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, column: str | int = "_text", most_bytes: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of up to `rows` rows whose texts have up to `most_bytes` bytes; a longer text is a slice of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64)])
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(ends, ends[start] + most_bytes, side="right")) - 1
            end = min(max(end, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def numbered(df: DataFrame, columns: Sequence[str], text_column: str) -> tuple[DataFrame, list[str], str]:
    """`df` with `columns` under names that clash with no made column, these names, and the name of the text.

    The text is one of the columns if it is among them, so that it is not carried twice.
    """
    names = [f"_in{i}" for i in range(len(columns))]
    if text_column not in columns:
        return df.select(*[F.col(c).alias(n) for c, n in zip(columns, names)], F.col(text_column).alias("_in_text")), names, "_in_text"
    # Taken by place where all columns are carried: their names may hold dots.
    shown = df.toDF(*names) if list(columns) == df.columns else df.select(*[F.col(c).alias(n) for c, n in zip(columns, names)])
    return shown, names, names[list(columns).index(text_column)]


def with_arrays(
    df: DataFrame,
    text_column: str,
    start: Callable[[], Callable[[list[str | None]], Sequence[pa.Array]]],
    made: str,
    keep: Sequence[str] | None = None,
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """`df` with the columns `made` (a schema string), computed in Arrow batches from the texts.

    `start` runs once in each task and returns the function that maps a slice of texts to arrays, so a
    task can keep a memory between slices. `keep` names the columns to carry along (default: all). A
    carried column with the name of a made one is replaced. A text that is carried along reaches the task once.
    """
    fields = T.StructType.fromDDL(made)
    carried = [c for c in (df.columns if keep is None else keep) if c not in fields.names]
    inner = [f"_c{i}" for i in range(len(carried))]
    at = carried.index(text_column) if text_column in carried else len(carried)
    beside = [] if text_column in carried else [df[text_column].alias("_text")]
    shown = df.select(*[df[c].alias(i) for c, i in zip(carried, inner)], *beside)
    schema = T.StructType([T.StructField(i, df.schema[c].dataType) for c, i in zip(carried, inner)] + fields.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        for part in slices(batches, rows, at):
            texts = part.column(at).to_pylist()
            kept = [part.column(i) for i in range(len(inner))]
            yield pa.RecordBatch.from_arrays([*kept, *function(texts)], names=[*inner, *fields.names])

    result = shown.mapInArrow(run, schema)
    return result.select(*[F.col(i).alias(c) for c, i in zip(carried, inner)], *fields.names)
