"""A training corpus from raw documents, in five stages over the operators of tallywell.llm.

Each stage takes what the stage before kept, written as Parquet and read again,
and returns the columns of documents; the last returns what its token files hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywell.llm.decontaminate import drop_leaks
from tallywell.llm.mixing import mixed_documents
from tallywell.llm.prefix_tree import keep_one
from tallywell.llm.queries import table, tokenizer
from tallywell.llm.session import fresh_path, save
from tallywell.llm.token_files import describe_token_files, write_token_files
from tallywell.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay, with all their columns.

    Null and empty texts score as texts without evidence; rows of one text stay
    or go together; a null id plays no part in training. An empty table stays empty.
    """
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingle sets, the document with the least doc_id stays.

    Null, empty and blank texts are linked with nothing and stay, each of them;
    documents of fewer than five words are linked if all their words are the same. Of rows
    that repeat the least id one stays; null ids give way to others. An empty table stays empty.
    """
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 75 % of the shingles of every test item stay.

    Null and empty texts hold none and stay; repeated rows stay or go together,
    whatever their ids, null ones too. Items without words are in no document. Empty tables change nothing.
    """
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it (0 to 2 times).

    Null and empty texts have no words and are never taken. A null source is a
    source, the last; null ids are in the order of their texts, and rows that repeat
    in all columns are taken as one of them is. An empty table stays empty.
    """
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files, and describes each document from them.

    In ascending doc_id, null ids first; rows of one id in the order of their
    texts. Null and empty texts have the end id alone. An empty table gives no rows.
    """
    path = fresh_path(spark, "token-files")
    write_token_files(docs, path, tokenizer())
    return describe_token_files(spark, path)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("token_files", token_files)]

#: Neither scores nor token ids can be had from SQL; tests/llm holds the operators against brute-force versions, toxicity's scores excepted.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
