"""A corpus made ready for training in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents.  `run` chains them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.llm.common import table, written
from tellurion.llm.language import UNKNOWN, fit_language_model, identify
from tellurion.llm.mixing import mix
from tellurion.llm.neardup import keep_one
from tellurion.llm.pieces import piece_digests
from tellurion.llm.toxicity import fit_toxicity, score_severity

#: No stage's rows can be had by SQL; tests/llm/test_pipeline.py holds each against brute force.
ORACLE_SQL = None


def whole_rows(docs: DataFrame) -> DataFrame:
    """The text beside the whole row, so that no column of a row can clash with what an operator adds."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's `lang` becomes the language its text is found to be in, whatever it said before.
    Documents without a letter, in which no language can be told, go."""
    found = identify(whole_rows(docs), fit_language_model(docs)).where(F.col("lang_pred") != UNKNOWN)
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col("_row")[c].alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rather toxic than not, of any grade, go."""
    scored = score_severity(whole_rows(docs), fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.where(~F.col("toxic")).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, up to three times or not at all, whether its doc_id is null,
    its own or that of other rows too."""
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, as op5 gives them."""
    import public_tokenizers

    return piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
