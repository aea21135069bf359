"""A corpus pipeline: toxic documents go, one of each group of near copies stays, documents with
benchmark items go, secrets are masked, and what is left becomes pieces.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents.  ``run`` writes each stage's result as Parquet in the shared folder and reads it as
the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridewell.llm.decontaminate import drop_contaminated
from stridewell.llm.jaccard import keep_one
from stridewell.llm.secrets import redact
from stridewell.shared import written
from stridewell.llm.text import read_table
from stridewell.llm.toxicity import drop_toxic, train
from stridewell.llm.unigram import encode
from stridewell.session import ship_package


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier, trained on the labelled ones among them, doesn't call toxic.

    Null and empty texts, repeated rows and rows of a null id are scored like any other and keep
    their columns; an empty table gives no rows, and without labels all stay.
    """
    ship_package(spark)
    return drop_toxic(docs, train(docs, read_table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id, then of the least hash of its text.

    Null and empty texts are nobody's copies, and rows of a null id stay; of rows equal in id and
    text one stays; rows of one id with unrelated texts are judged apart.  An empty table gives no rows.
    """
    ship_package(spark)
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each row judged by its own text.

    Null and empty texts hold none; an empty table gives no rows, and an empty benchmark drops none.
    """
    ship_package(spark)
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets and linked parts of credentials masked and n_chars counted anew.

    A null text stays null, an empty one empty; repeated rows and null ids are masked like any other.
    """
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the piece ids of each document, their number, and whether they decode to its text.

    A row for each document: null and empty texts have no pieces, repeated rows and null ids stay.
    """
    ship_package(spark)
    out = encode(docs)
    return out.select(F.col("id").alias("doc_id"), "ids", F.size("ids").cast("long").alias("n_pieces"), "round_trip")


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("sentencepiece", sentencepiece),
]

#: A trained classifier and piece ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
