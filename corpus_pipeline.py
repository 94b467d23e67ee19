"""The corpus pipeline: quality filter, near-duplicate removal, pseudonyms, source mixing, packing.

Each stage maps (spark, docs, sf_dir) to a frame that is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echoloom.llm.common import drop_stored, store, table
from echoloom.llm.mixing import mix
from echoloom.llm.neardup import keep_one
from echoloom.llm.packing import pack
from echoloom.llm.pii import pseudonymize_rows
from echoloom.llm.quality import fit_quality, keep_good
from echoloom.llm.queries import KEY


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on weak labels of these documents, does not reject.

    Null and empty texts are judged by the outcome of no words; repeated rows are judged alike, very long texts whole. Rows
    without an id stay rows. An empty table gives an empty result; columns of any names are kept as they are.
    """
    return keep_good(docs, fit_quality(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id: five-word shingles, similarity 0.8 or more.

    Null and empty texts are near nothing and stay, as do rows without an id; of repeated rows of an id one stays. Very
    long texts are compared by all their shingles. An empty table gives an empty result; columns of any names are kept.
    """
    return keep_one(docs, shingle=5, num=80, den=100)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by pseudonyms of their format; n_chars follows the new text.

    Null and empty texts stay as they are, with their n_chars; repeated rows are treated alike, very long texts whole. An
    empty table gives an empty result; other columns are kept as they are.
    """
    return pseudonymize_rows(docs, KEY, length_col="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in tempered shares of their sources; those of a second pass occur twice.

    A null source is a source of its own; documents without words go with their pass, equal rows stand and go together, a
    very long document counts with all its words. An empty table gives an empty result; columns of any names are kept.
    """
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its length bucket, batch and slot.

    Null and empty texts have length 0; equal lengths are ordered by id and text; a text longer than the budget of a batch
    has one of its own. Repeated rows are packed each. An empty table gives an empty result.
    """
    return pack(docs, keep=[c for c in ("source", "n_chars") if c in docs.columns])


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixture), ("packing", packing)]

#: The first two stages are a fitted classifier and MinHash, which SQL can't express; a brute-force test holds run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = store(stage(spark, docs, sf_dir))
        if last:
            drop_stored(spark, last)
        last = path
    return docs
