"""From raw documents to packed training sequences, in stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept. All but the last return the columns of
`documents`; n_chars follows the text. The last returns where every token piece goes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import materialize, read
from chronoframe.llm.lines import deduplicated
from chronoframe.llm.mixing import mixed_documents
from chronoframe.llm.neardup import one_of_each
from chronoframe.llm.packing import packed_documents
from chronoframe.llm.quality import kept_by_quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return kept_by_quality(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave the texts; no document goes."""
    out = deduplicated(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return one_of_each(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixed_documents(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in the training sequences."""
    return packed_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("near-duplicates", near_duplicates), ("source mixing", mixture), ("packing", packing)]

#: The classifier, the fuzzy links and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage's rows written and read again as the next one's."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
