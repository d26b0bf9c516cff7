"""A corpus pipeline of five stages over documents: quality, near copies, benchmark leaks, personal data, source mix.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. run() applies them to the table, each stage written to the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import staged, table
from quire.llm.decontam import drop_leaks
from quire.llm.mixing import mix_counts
from quire.llm.ngramjoin import drop_near_copies
from quire.llm.pii import redact
from quire.llm.quality import judge_quality


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is fitted on these documents, with the table of labels."""
    return judge_quality(docs, table(spark, sf_dir, "labels")).where("keep").select(*docs.columns)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near copies."""
    return drop_near_copies(docs)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a mix of the sources takes of each document."""
    return mix_counts(docs)


STAGES = [
    ("quality", keep_good),
    ("near copies", keep_one_of_copies),
    ("leaks", keep_unleaked),
    ("personal data", mask_personal_data),
    ("mix", mix),
]

#: The classifier's fit is no SQL; the tests hold the pipeline against stages made by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
