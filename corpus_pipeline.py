"""A training-data pipeline: quality rules, near copies, personal data, mixing, and token ids.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each
result as Parquet in the folder that driver and executors share, and reads it again as the next stage's docs. All but
the last return the columns of documents. The mix repeats documents, so its rows are told apart by doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graniteloom.llm import bpe, mixing, ngram_join, pii, rules
from graniteloom.llm.common import Scratch, documents, forget, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule, with their columns.

    A null or empty text fails (it has no words). Rows are judged one by one: null and repeated ids and repeated rows
    change nothing, texts are read whole, and an empty table gives an empty one.
    """
    return rules.quality_rules(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id (null last), with its columns.

    Rows are told apart by their place in the table: rows with a null or a repeated doc_id are documents like any other.
    Texts without words have no copies and stay. An empty table gives an empty one.
    """
    return ngram_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to the names of its kinds; n_chars follows, other columns stay.

    Every row stays, whatever its id; a null text stays null. An empty table gives an empty one.
    """
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: documents repeated, left out, or taken in part; n_chars follows.

    A null source is one source, after the others. Rows without words take none, so they are not in the mix. Rows are
    told apart by their place in the table, whatever their ids. An empty table gives an empty one.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and digests of the ids, and of the text decoded from them, for each row of the mix.

    A null or empty text has no tokens. Rows are independent: null and repeated ids and repeated rows change nothing. An
    empty table gives an empty one.
    """
    rows = bpe.encode(docs.select("doc_id", "source", "text"), bpe.vocabulary_path(), decoded="decoded")
    return bpe.digests(rows, ["doc_id", "source"])


STAGES = [
    ("quality_rules", quality),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("source_mix", mix),
    ("token_ids", tokens),
]

#: Byte-level BPE and signature trees are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each in a scope of its own: of what a stage writes only its result stays, and that goes when the next
    stage's is written."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        with Scratch(spark) as scratch:
            made = scratch.keep(written(stage(spark, docs, sf_dir)))
        forget(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
