"""From raw documents to packed training sequences, stage by stage.

Every stage takes documents (doc_id, text, lang, source, n_chars and any further columns, of
whatever names) and all but the last return the same columns. Rows are told apart by numbers of
their own: null, repeated and shared doc_ids are rows like any other. Texts may be null, empty or of
any length; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import wraps
from threading import local

from pyspark.sql import DataFrame, SparkSession

from saltmarsh.llm import exact_dedup, mixing, packing, quality, simhash
from saltmarsh.llm.common import collecting, discard, reads, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the word rules or lie outside their group's robust ellipsoid go.

    Null and empty texts have too few words and go; null languages and sources are groups of their own;
    repeated rows stay or go together, each judged by its own text.
    """
    return quality.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest identifier stays, one of them if several have it.

    Equal: identical after lower-casing A-Z; null and empty texts are equal; null identifiers come last.
    """
    return exact_dedup.drop_exact_duplicates(docs, keep="min")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked at a similarity of 0.8 or more (of five-word shingles) the row with
    the smallest identifier stays, exactly one. Null, empty and wordless texts are one group; texts of
    under five words are one shingle; null identifiers come last."""
    return simhash.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's texts: a row for every stretch of a document that a shard of the mix takes.

    Documents without words are never taken; null sources are one source.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-length sequences: one row per piece, with its ids. A null or empty text is its end id alone."""
    return packing.pack_documents(docs)


class _Left(local):
    """The tables that the stages called last in this thread have left."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []


_left = _Left()


def _alone(stage):
    """The stage, deleting the tables that the stages before it left, unless docs is still to be made from
    them: stages may be called one on the other's result as it is, or as it has been written."""

    @wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if stage is quality_rules:
            _left.tables = []  # another run begins; what the last one returned may not have been used yet
        elif _left.tables and not reads(docs, _left.tables):
            discard(*_left.tables)
            _left.tables = []
        with collecting() as tables:
            out = stage(spark, docs, sf_dir)
        _left.tables += tables
        return out

    return call


STAGES = [
    ("quality rules", _alone(quality_rules)),
    ("exact dedup", _alone(exact_duplicates)),
    ("near dedup", _alone(near_duplicates)),
    ("mixing", _alone(source_mix)),
    ("packing", _alone(packed)),
]

#: Robust estimates, fingerprints and tokenizers have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if before is not None:
            discard(before)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    _left.tables = []  # what the result reads stays
    return out
