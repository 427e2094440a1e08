"""The corpus pipeline: language identification, near-duplicate removal, substring removal, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir), where docs are all documents that the stage before it
kept, and returns a DataFrame; all but the last return the columns of documents. run() writes
each stage's result as Parquet to the shared folder and reads it again as the next one's docs.

Defined results of every stage: no documents give no documents; extra columns stay, whatever
their names; repeated rows are documents of their own. Null, empty and blank texts and texts
without a letter go in the first stage, unless nothing was there to learn a language from; what
gets this far without a text stays a class of its own in the second, goes in the third, and has
no tokens in the last. Ties between near-duplicates go to the least doc_id, of equal ids to the
least text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import decontaminate, language, near, pieces, windows
from sheaf.llm.columns import box, boxed
from sheaf.llm.spaces import release, shared_dir


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the calibrated model rejects, or that have no letter, go.

    The model learns from the labelled documents of this stage that are not held out.
    """
    return language.confident(docs, language.fit(docs.filter(~language.held_out("doc_id"))))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each class of near-duplicates the document with the least doc_id stays."""
    return near.deduplicated(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: words in windows of 20 words that start earlier are cut out; documents of which nothing stays go."""
    return with_length(windows.cleaned(docs), empty=False)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: spans of benchmark items are cut out, and documents that are little else go."""
    cleaned = decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return with_length(cleaned)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: token ids of each text under seeded merge-dropout, and whether they decode to it."""
    return pieces.encoded_and_checked(docs)


def with_length(docs: DataFrame, empty: bool = True) -> DataFrame:
    """docs with n_chars, if they have it, as the text now is; without texts that are blank or null if not `empty`."""
    inner, text = boxed(docs), box(docs, "text")
    if "n_chars" in docs.columns:
        n = box(docs, "n_chars")
        inner = inner.withColumn(n, F.length(text).cast(inner.schema[n].dataType))
    if not empty:
        inner = inner.filter(F.length(F.trim(text)) > 0)
    return inner.toDF(*docs.columns)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        release(spark)
    return docs
