"""The corpus pipeline: toxic documents go, near copies go, repeated passages go, sources are mixed, texts are encoded.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the
next stage's documents. All but the last return the columns of documents, and any others that ``docs`` has, whatever their
names. No rows in, none out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm import bpe, mixing, simhash, substring, toxicity
from parley.llm import common
from parley.llm.common import compact, cut, drop, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go; it learns from the labelled ones among ``docs``.

    Null and empty texts are one window without words and stay unless such texts were labelled toxic. Repeated rows and ties
    of score go alike. Without labels, or with labels of one kind, nothing is learned: all stay, or none if all labels are toxic.
    """
    scorer = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return compact(toxicity.keep_clean(docs, scorer))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: 5-word shingles, a similarity of 0.8 and more, found by SimHash and settled by whole sets.

    The smallest doc_id of a group stays, with all rows that share it; rows with a null doc_id stay. Null and empty texts are
    copies of each other.
    """
    return compact(simhash.keep_first(docs, width=5, similarity=0.8))


def substrings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more stay in their first document only; documents of which nothing is left go.

    Null texts stay; empty ones have nothing left and go. Rows that share a doc_id take nothing from each other, rows with a
    null doc_id lose nothing.
    """
    return compact(substring.remove_repeats(docs).filter("text IS NULL OR text <> ''"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix sends them.

    Documents without words are never sent and go. A null source is a source. Repeated rows are sent each for itself.
    """
    return compact(mixing.mixed_documents(docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every document of the mix, row by row; null and empty texts have no tokens."""
    return compact(bpe.encode_documents(docs, bpe.default_path()))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("substrings", substrings_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: The network's scores have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result written to the shared folder and read again; what a stage wrote on its way goes then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.run() as steps:
            out = cut(stage(spark, docs, sf_dir), f"stage-{name}")
            steps.release(spark, out)
        drop(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
