"""The training-data pipeline over documents: quality, toxicity, near duplicates, decontamination, mixing.

Each stage takes all that the one before kept. The first four return the columns of documents, others that are there
included; the last returns the mix: a row for each document that the mix takes, with the columns of documents and size,
source_size, target, taken (its words, repeats counted), shards (one for each time it is taken) and orders (by which
the rows of each shard are sorted, which shuffles it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatquarry.llm import decontaminate, jaccard_join, mixing, quality, toxicity
from chatquarry.llm._shared import Scratch, crc_of, table


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade above the lowest is quality.SELECT at least.

    Null texts and those without words have the grade that the thresholds alone give, which may keep or drop them all;
    long texts are graded whole, rows that repeat alike, rows without an id by their text. Without ratings all stay,
    an empty table stays empty. Other columns pass, whatever their names.
    """
    grader = quality.learn(quality.labelled(docs, table(spark, sf_dir, "labels"), quality.SAMPLE))
    return quality.select(docs, grader, select=quality.SELECT)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels outside the held-out fold, doesn't reject.

    Null and empty texts have no hits and the score of such; long texts are scored whole, rows that repeat alike, rows
    without an id by their text. Without labels of both kinds all stay, an empty table stays empty. Other columns pass,
    whatever their names.
    """
    labels = table(spark, sf_dir, "labels").where(F.pmod(crc_of("doc_id"), F.lit(5)) != 0)
    return toxicity.reject(docs, toxicity.learn(toxicity.labelled(docs, labels, toxicity.SAMPLE)))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies, the one with the smallest id.

    Null, empty and blank texts stay, but for rows that repeat id and text, which are one; rows without an id go where
    their group has one with an id, else one stays; different texts of one id all stay. Long texts are compared whole,
    an empty table stays empty. Other columns pass, whatever their names.
    """
    return jaccard_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as it is or with other slots.

    Null and empty texts stay; rows of an id go together, rows without an id each by its text; long texts are searched
    whole. Without items all stay, an empty table stays empty. Other columns pass, whatever their names.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left, a row per document taken.

    A null source is a source, the last; null and empty texts have no words and go with their block; rows that repeat
    an id are taken together, a null id is an id; an empty table stays empty. A column of documents that has the name
    of one of the mix's is `<name>_of_document`.
    """
    return mixing.mixed(docs)


STAGES = [("quality", by_quality), ("toxicity", without_toxic), ("near_duplicates", without_copies), ("decontamination", without_benchmark), ("mixing", mixed)]

#: The first three stages learn or link by hashes, which SQL can't express; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each but the last written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name, wide=True)
            scratch.drop(before)
    return docs
