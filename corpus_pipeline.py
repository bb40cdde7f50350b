"""From raw documents to token ids: five stages, each on all rows that the one before has kept.

Quality classifier, line dedup, SimHash near-dedup, mixing to target weights, SentencePiece encoding. Every stage but the
last returns the columns of `documents`, extra ones as they are, whatever their names; the last one returns doc_id and
ids, one row for each copy in the mixture. An empty table gives no rows at any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from embertrail.llm.common import saved, table
from embertrail.llm.lines import without_repeats
from embertrail.llm.mixing import mix_documents
from embertrail.llm.pieces import encoded
from embertrail.llm.quality import keep_good
from embertrail.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows of `docs`, doesn't reject.

    Null and empty texts are scored like texts without words; repeated rows are kept or go together.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier, equal or nearly so; those with nothing left go.

    Null, empty and blank texts stay as they are. Rows that repeat id and text lose the same lines, so they stay together.
    """
    return without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Texts without words, null ones too, are copies of each other. A row without an id stays.
    """
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it. Null and empty texts have size 0; a null source is a source."""
    return mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of the whole text, none for a null or empty one; repeated rows are encoded each. Workers remember few words: they also hold what earlier stages left in memory."""
    return encoded(docs, remember=100_000)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage keeps is written to the shared checkpoint folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs


#: The classifier, the edit join, the groups of near copies and the sampling are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
