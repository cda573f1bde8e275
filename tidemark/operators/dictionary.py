"""Indicator features for columns of very many categories: a dictionary table and sparse vectors.

`prep` makes an indicator column of every category, which is right for a few dozen. Here the categories are rows of a
table: (name, value, place), one for every category but the smallest of its column, with consecutive places. A row's
categories find their places by joins, each of which the optimizer may broadcast or shuffle, and the row becomes a sparse
vector. Nothing that grows with the number of categories reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.joins import left_join_sparse_key
from tidemark.functions.numbering import number_rows
from tidemark.functions.staging import Stage, stage


@dataclass(frozen=True)
class CategoryDictionary:
    """`table` is (name, value, place); vectors have `size` places for categories."""

    table: DataFrame
    columns: tuple[str, ...]
    size: int

    def places(self, df: DataFrame, made: str = "places") -> DataFrame:
        """`df` with the sorted places of its categories; nulls, unseen values and the smallest category have none."""
        rows = df
        found = [f"_place{i}" for i in range(len(self.columns))]
        for name, place in zip(self.columns, found):
            own = self.table.filter(F.col("name") == name).select(F.col("value").alias("_value"), F.col("place").alias(place))
            # Rows without a value match nothing and are spread; a value of very many rows is left to the skew join.
            rows = left_join_sparse_key(rows.withColumn("_value", F.col(name).cast("string")), own, "_value").drop("_value")
        return rows.withColumn(made, F.array_sort(F.array_compact(F.array(*found)))).drop(*found)

    def vectors(self, df: DataFrame, numeric: Sequence[str] = (), keys: Sequence[str] = (), made: str = "features") -> DataFrame:
        """`keys` and a sparse vector: the indicators, then the numeric columns, in which null counts as 0."""
        size, width = self.size, self.size + len(numeric)
        numbers = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric]) if numeric else F.expr("cast(array() as array<double>)")
        rows = self.places(df, "_places").select(*keys, F.col("_places"), numbers.alias("_numbers"))
        schema = T.StructType([rows.schema[k] for k in keys]).add(made, VectorUDT())

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ones, values = batch.column(len(keys)), batch.column(len(keys) + 1)
                counts = np.diff(ones.offsets.to_numpy())
                many = values.offsets[1].as_py() - values.offsets[0].as_py() if batch.num_rows else 0
                ends = np.concatenate([[0], np.cumsum(counts + many)])
                index = np.empty(ends[-1], dtype=np.int32)
                value = np.ones(ends[-1])
                # Of each row first the places, then the numbers.
                is_number = np.zeros(ends[-1], dtype=bool)
                if many:
                    at = (ends[1:, None] - many + np.arange(many)).ravel()
                    is_number[at] = True
                    index[at] = np.tile(size + np.arange(many), batch.num_rows)
                    value[at] = values.flatten().to_numpy()
                index[~is_number] = ones.flatten().to_numpy()
                offsets = pa.array(ends, pa.int32())
                parts = {
                    "type": pa.array(np.zeros(batch.num_rows, dtype=np.int8)),
                    "size": pa.array(np.full(batch.num_rows, width, dtype=np.int32)),
                    "indices": pa.ListArray.from_arrays(offsets, pa.array(index)),
                    "values": pa.ListArray.from_arrays(offsets, pa.array(value)),
                }
                vector = pa.StructArray.from_arrays(list(parts.values()), names=list(parts))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keys))], vector], names=schema.names)

        return rows.mapInArrow(build, schema)


def fit_dictionary(train: DataFrame, columns: Sequence[str], keep: Stage = stage) -> CategoryDictionary:
    """The categories of the columns, in their order and each column's by value, numbers as numbers.

    The smallest value of a column is its baseline and has no place. Nulls are no category.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("column"), F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    seen = train.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null").distinct()
    seen = keep(seen.withColumn("by", F.struct(F.col("value").try_cast("double").alias("number"), "value")), "categories")
    lowest = seen.groupBy("name").agg(F.min("by").alias("baseline"))
    others = seen.join(F.broadcast(lowest), "name").filter(F.col("by") != F.col("baseline")).select("column", "name", "value", "by")
    table = keep(number_rows(others, ["column", "by"], "place", keep=keep).select("name", "value", F.col("place").cast("int").alias("place")), "dictionary")
    return CategoryDictionary(table, tuple(columns), table.count())
