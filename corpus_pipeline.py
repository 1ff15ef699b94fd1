"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and
reread as the next one's docs. All but the last give the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.bpe import bpe_encode
from loomgraph.llm.exact_dedup import drop_copies
from loomgraph.llm.mixing import mixed
from loomgraph.llm.ngram_join import drop_near_copies
from loomgraph.llm.queries import vocabulary
from loomgraph.llm.scratch import Scratch
from loomgraph.llm.toxicity import drop_toxic, train
from loomgraph.ship import ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fitted on the labels table, does not reject as toxic."""
    ship(spark)
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    ship(spark)
    return drop_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the row with the smallest doc_id."""
    ship(spark)
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: up to 3 times, or not at all."""
    ship(spark)
    return mixed(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the decoded text, a row per copy."""
    ship(spark)
    return bpe_encode(docs, vocabulary(), digests=True)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_join", ngram_join), ("mixing", mixing), ("bpe", bpe)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = len(STAGES) - 1
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < last:
            docs = scratch.table(docs, name)
        if i > 1:
            scratch.drop(STAGES[i - 2][0])
    return docs
