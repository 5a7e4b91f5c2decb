"""A corpus pipeline over ``documents``: each stage calls one operator of ``kpispark.llm``.

Every stage reads all that the stage before it kept, and all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpispark.llm.common import table
from kpispark.llm.mixing import mix
from kpispark.llm.ngram_join import drop_near_copies
from kpispark.llm.pieces import Pieces, add_ids
from kpispark.llm.pii import redact
from kpispark.llm.toxicity import drop_toxic
from kpispark.session import cut_lineage


#: Token shares of the mixed corpus: round shares set beforehand, whatever the documents bring.
TARGETS = {"english": 0.5, "other": 0.3, "low": 0.2}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked texts stays."""
    return drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat until the domains' token shares meet the targets; none goes (rates of 1 or more)."""
    return mix(docs, table(spark, sf_dir, "labels"), targets=TARGETS, least_rate=1.0)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the texts, with the documents' tags."""
    return add_ids(docs, Pieces()).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: Character models, iterative fitting and tokenisation are beyond SQL; tests/llm has brute-force checks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
