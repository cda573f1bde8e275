"""A corpus pipeline: the stages of `STAGES`, each of which works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.staging import stage
from tidemark.llm import decontaminate, language, pieces, similar, toxicity
from tidemark.llm.common import numbered, read, remainder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

PIECE_MODEL = "piece_bpe_32k.model"
# One in so many rows, by the checksum of the id, measures the border of known languages.
HELD_OUT = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model does not predict as toxic; it learns from the rows of `labels`.

    Null and empty texts are scored as such; equal texts have one score, so repeated rows stay or go together. Without
    labelled rows nothing is toxic. A score at the border of the prediction counts as toxic.
    """
    model = toxicity.learn(spark, docs, read(spark, sf_dir, "labels"))
    return toxicity.score(spark, docs, model).filter("predicted = 0").select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language of the table.

    Null texts and texts without letters go, and so do those that resemble no language of the table, as random letters
    do. The border is measured on rows that the profiles have not seen. Rows with a null `lang` teach nothing and are
    judged; without any labelled row no language is known and all rows go.
    """
    unseen = F.coalesce(remainder("doc_id", HELD_OUT) == 0, F.lit(False))
    profiles = language.learn_profiles(docs.filter(~unseen))
    border = language.learn_border(language.identify(spark, docs.filter(unseen), profiles, keep=["lang"]))
    shown, names, text = numbered(docs, docs.columns, "text")
    found = language.identify(spark, shown, profiles, text, names)
    return found.filter(border.known()).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts with five-word Jaccard similarities of 0.8 or more: the smallest id, null ids last.

    Repeated rows and equal texts are one group, whatever their ids; null texts are one, and texts without words are
    near to equal ones only. Of rows with one id in a group the smallest checksum stays.
    """
    return similar.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of a benchmark item occurs.

    Null texts and texts without words stay; repeated rows stay or go together; an empty `benchmark` drops nothing.
    """
    return decontaminate.without_contaminated(spark, docs, read(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): the token ids with an end id, and whether they decode to the text itself.

    A null text is encoded as an empty one. Every row stays, repeated ones too.
    """
    rows = pieces.encode_and_decode(spark, docs, public_tokenizers.path(PIECE_MODEL), keep=["doc_id", "text"])
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pieces", to_pieces),
]
# Trees, random letter vectors, XXH64 and merge rounds have no SQL form: tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`; every stage's result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for number, (name, function) in enumerate(STAGES, 1):
        docs = function(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stage(docs, name)
    return docs
