"""The headerless text form of the feature table: \\x01 between fields, \\N for null, UTF-8, one row a line.

Backslashes, separators and line ends inside a value are written as escapes, so every value comes back as it was; a value
without any of them is written as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field separator and null marker of the text form.
SEPARATOR = "\x01"
NULL = "\\N"
# Characters with a form of their own inside a value, and that form.
ESCAPES = {"\\": "\\\\", SEPARATOR: "\\1", "\n": "\\n", "\r": "\\r"}


def _escaped(value: Column) -> Column:
    for character, form in ESCAPES.items():
        value = F.replace(value, F.lit(character), F.lit(form))
    return value


def _unescaped(value: Column) -> Column:
    """Between two escaped backslashes a backslash begins an escape, so the parts are read one by one."""

    def part(text: Column) -> Column:
        for character, form in reversed(ESCAPES.items()):
            text = F.replace(text, F.lit(form), F.lit(character)) if character != "\\" else text
        return text

    return F.when(F.contains(value, F.lit("\\")), F.array_join(F.transform(F.split(value, r"\\\\"), part), "\\")).otherwise(value)


def _bad_escape(value: Column) -> Column:
    """A backslash that begins no escape."""
    return value.rlike(r"^(?:[^\\]|\\[\\1nr])*+\\")


def write_text(df: DataFrame, path: str) -> None:
    """Write all columns in order, each as its text. Only columns whose text can be cast back are allowed."""
    kinds = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    nested = [f.name for f in df.schema if isinstance(f.dataType, kinds)]
    if nested:
        raise ValueError(f"{', '.join(nested)} cannot be written as text")
    fields = [F.col(f"`{f.name}`").cast("string") for f in df.schema]
    fields = [
        F.coalesce(_escaped(text) if isinstance(f.dataType, T.StringType) else text, F.lit(NULL)) for f, text in zip(df.schema, fields)
    ]
    df.select(F.concat_ws(SEPARATOR, *fields).alias("value")).write.option("lineSep", "\n").text(path)


def _reason(schema: T.StructType) -> Column:
    """Why `fields` are not a row: their number, or the first field that is missing or not of its type; null for a row.

    Fields of one type are tested by one expression over their places, so the plan stays small for any number of columns.
    """

    def failing(places: list[int], wrong: Callable[[Column], Column], kind: int) -> Column:
        """Codes 2 * place + kind of the fields of these places that are wrong."""
        bad = F.filter(F.array(*[F.lit(p) for p in places]), lambda p: wrong(F.get("fields", p)))
        return F.transform(bad, lambda p: p * 2 + kind)

    codes = []
    required = [i for i, f in enumerate(schema) if not f.nullable]
    if required:
        codes.append(failing(required, lambda text: text == NULL, 0))
    for kind in dict.fromkeys(f.dataType for f in schema):
        places = [i for i, f in enumerate(schema) if f.dataType == kind]
        if isinstance(kind, T.StringType):
            codes.append(failing(places, lambda text: (text != NULL) & _bad_escape(text), 1))
        else:
            codes.append(failing(places, lambda text, kind=kind: (text != NULL) & text.try_cast(kind).isNull(), 1))
    first = F.array_min(F.concat(*codes))
    messages = [m for f in schema for m in (f"{f.name} is missing", f"{f.name} is not {f.dataType.simpleString()}")]
    of_field = F.get(F.array(*[F.lit(m) for m in messages]), first)
    number = F.concat(F.size("fields").cast("string"), F.lit(f" fields of {len(schema)}"))
    return F.when(F.size("fields") != len(schema), number).otherwise(of_field)


def _parsed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(line, reason, one column for each field, named by its place): `reason` is null for a line that is whole."""
    lines = spark.read.option("lineSep", "\n").text(path)
    # Generated columns are not put into the expressions that use them: a line is split and judged once.
    split = lines.select(F.col("value").alias("line"), F.explode(F.array(F.split("value", SEPARATOR))).alias("fields"))
    judged = split.select("*", F.explode(F.array(_reason(schema))).alias("reason"))
    columns = []
    for place, field in enumerate(schema):
        text = F.get("fields", F.lit(place))
        known = F.when(text != NULL, text)
        value = _unescaped(known) if isinstance(field.dataType, T.StringType) else known.try_cast(field.dataType)
        columns.append(value.alias(f"_{place}"))
    return judged.select("line", "reason", *columns)


def read_text_with_rejects(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): the rows by position under the schema, and (line, reason) of every line that is not one.

    A line is rejected for the number of its fields, or for the first field that is not of its type, holds an unknown
    escape, or is null where the schema allows none. Empty text is empty text.
    """
    parsed = _parsed(spark, path, schema)
    rows = parsed.filter("reason is null").select(*[F.col(f"_{i}").alias(f.name) for i, f in enumerate(schema)])
    return rows, parsed.filter("reason is not null").select("line", "reason")


def reject_counts(rejects: DataFrame) -> DataFrame:
    """(reason, lines) of the rejected lines, the most frequent first."""
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("lines")).orderBy(F.desc("lines"), "reason")


def read_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read by position under an explicit schema; a line that is not a row fails the read."""
    parsed = _parsed(spark, path, schema)
    failed = F.raise_error(F.concat(F.lit("a line is not a row: "), F.col("reason")))
    checked = parsed.filter(F.when(F.col("reason").isNull(), True).otherwise(failed.cast("boolean")))
    return checked.select(*[F.col(f"_{i}").alias(f.name) for i, f in enumerate(schema)])
