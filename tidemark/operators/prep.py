"""From the feature table to a numeric design matrix.

Everything learned from data (means, categories, centers, scales) is fitted once on the training
rows and applied unchanged to any later cohort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Vocabulary
from tidemark.functions.expr import hash_number, ratio, row_hash
from tidemark.schema import CATEGORICAL, IMPUTED, KEYS, NUMERIC


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows per class, and negatives per positive."""
    counts = df.agg(
        F.count(F.when(F.col(label) == 0, 1)).alias("negatives"),
        F.count(F.when(F.col(label) == 1, 1)).alias("positives"),
    )
    return counts.withColumn("negatives_per_positive", ratio(F.col("negatives"), F.col("positives")))


def encode_ordinals(df: DataFrame, words: Vocabulary) -> DataFrame:
    """Codes for sex and age group; a value outside the list becomes null."""

    def coded(name: str, codes: dict[str, int]):
        branches = [F.when(F.col(name) == word, F.lit(code).cast("bigint")) for word, code in codes.items()]
        return F.coalesce(*branches)

    return df.withColumns({"sex": coded("sex", words.sex_codes), "age_group": coded("age_group", words.age_group_codes)})


def _double(value: float) -> str:
    return f"{value!r}D"


@dataclass(frozen=True)
class PrepModel:
    """Fitted means, categories, centers and scales.

    Each output column is a SQL expression, so the same text serves a DataFrame and a stage that is
    saved inside a `PipelineModel`.
    """

    means: dict[str, float | None]
    categories: dict[str, list[int]]
    centers: dict[str, float | None]
    scales: dict[str, float | None]
    keys: Sequence[str] = field(default=KEYS)

    def imputed(self, name: str) -> str:
        value = f"cast(`{name}` as double)"
        mean = self.means.get(name)
        return value if mean is None else f"coalesce({value}, {_double(mean)})"

    def scaled(self, name: str) -> str:
        center, scale = self.centers[name], self.scales[name]
        if center is None:
            return "cast(null as double)"
        return f"({self.imputed(name)} - {_double(center)}) / {_double(scale)}"

    @property
    def dummies(self) -> dict[str, str]:
        """Indicator columns; the smallest category of each column is the baseline."""
        return {
            f"{name}_{value}": f"case when `{name}` = {value} then 1 else 0 end"
            for name, values in self.categories.items()
            for value in values[1:]
        }

    @property
    def features(self) -> list[str]:
        return [*self.dummies, *self.centers]

    def expressions(self) -> dict[str, str]:
        return self.dummies | {name: self.scaled(name) for name in self.centers}

    def impute(self, df: DataFrame) -> DataFrame:
        return df.withColumns({name: F.expr(self.imputed(name)) for name in self.means})

    def one_hot(self, df: DataFrame) -> DataFrame:
        return df.select(*self.keys, *[F.expr(sql).alias(name) for name, sql in self.dummies.items()])

    def standardize(self, df: DataFrame) -> DataFrame:
        return df.select(*self.keys, *[F.expr(self.scaled(name)).alias(name) for name in self.centers])

    def transform(self, df: DataFrame) -> DataFrame:
        """Key and label columns, dummies, scaled columns."""
        return df.select(*self.keys, *[F.expr(sql).alias(name) for name, sql in self.expressions().items()])

    def matrix(self) -> dict[str, str]:
        """As `expressions`, with doubles only and 0, the training mean, for a value that is still missing."""
        return {name: f"coalesce(cast({sql} as double), 0D)" for name, sql in self.expressions().items()}

    def transform_matrix(self, df: DataFrame) -> DataFrame:
        return df.select(*self.keys, *[F.expr(sql).alias(name) for name, sql in self.matrix().items()])

    def as_stage(self, keys: Sequence[str]) -> SQLTransformer:
        """The matrix as a pipeline stage that lets the given columns through."""
        columns = ", ".join([f"`{k}`" for k in keys] + [f"{sql} as `{name}`" for name, sql in self.matrix().items()])
        return SQLTransformer(statement=f"select {columns} from __THIS__")


def _categories(df: DataFrame, names: Sequence[str], most: int | None = None) -> dict[str, list[int]]:
    """Sorted distinct values per column, read in one pass. Each becomes a column, so they come to the driver.

    With `most`, more values than that in one column are an error.
    """
    if not names:
        return {}
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("bigint").alias("value")) for n in names])
    found = df.select(F.explode(pairs).alias("p")).select("p.name", "p.value").filter("value is not null").distinct()
    values: dict[str, list[int]] = {name: [] for name in names}
    for name, value in found.collect():
        values[name].append(value)
    for name, own in values.items():
        if most is not None and len(own) > most:
            raise ValueError(f"{len(own)} categories in {name}, and {most} are allowed")
    return {name: sorted(own) for name, own in values.items()}


def fit_prep(
    train: DataFrame,
    numeric: Sequence[str] = NUMERIC,
    imputed: Sequence[str] = IMPUTED,
    categorical: Sequence[str] = CATEGORICAL,
    keys: Sequence[str] = KEYS,
    declared: Mapping[str, Sequence[int]] | None = None,
    max_categories: int | None = None,
) -> PrepModel:
    """Categories are the values seen in `train`, unless `declared` for a column; `max_categories` may bound them.

    One aggregate over all numeric columns and one distinct over all categories.

    Filling a column with its mean leaves the mean as it is and shrinks the population deviation by
    sqrt(known / all), so no second pass over the filled column is needed. A column with one value
    gets that value as center and 1 as scale.
    """
    stats = [F.count(F.lit(1)).alias("n")]
    for name in numeric:
        value = F.col(name).cast("double")
        for part, aggregate in (("avg", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max), ("n", F.count)):
            stats.append(aggregate(value).alias(f"{name}|{part}"))
    row = train.agg(*stats).first()
    means, centers, scales = {}, {}, {}
    for name in numeric:
        mean, low, high = (row[f"{name}|{part}"] for part in ("avg", "min", "max"))
        constant = low == high
        if name in imputed:
            means[name] = low if constant else mean
        centers[name] = low if constant else mean
        known = row[f"{name}|n"] / row["n"] if name in imputed and row["n"] else 1.0
        scales[name] = 1.0 if constant or mean is None else row[f"{name}|std"] * known**0.5
    declared = declared or {}
    seen = _categories(train, [name for name in categorical if name not in declared], max_categories)
    categories = {name: sorted(declared.get(name) or seen[name]) for name in categorical}
    return PrepModel(means, categories, centers, scales, tuple(keys))


def hash_split(df: DataFrame, id_column: str, test_percent: int = 20, seed: int = 42) -> DataFrame:
    """Adds `is_test`, decided by a hash of the id and so independent of the partitioning."""
    bucket = hash_number(row_hash(seed, F.col(id_column))) % 100
    return df.withColumn("is_test", F.when(bucket < test_percent, 1).otherwise(0))
