"""A training-corpus pipeline: each stage takes documents and returns those that go on; the last packs them into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, jaccard, packing, pii, quality
from lodestone.llm.shared import cut, drop_cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of all labelled documents of this stage scores 0.7 or more.

    A null text is judged as an empty one, very long ones are read in pieces, repeated rows are kept or dropped alike, and a score of exactly 0.7 is kept.  Without labels every score is 1/2, so nothing is kept.  No documents
    give none; further columns, whatever their names, go on as they are."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a Jaccard similarity of 0.8 of five-word shingles: that of the smallest doc_id.

    Documents without words (null, empty) are linked with nothing and stay, each.  Of repeated rows of one doc_id one stays; very long texts are read in pieces.  No documents give none; further columns go on as they are."""
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item (an item of fewer words is one window).

    Documents and items that are null, empty or without words match nothing; repeated rows are judged each; very long texts are read in pieces.  An empty benchmark keeps all documents; further columns go on as they are."""
    return decontaminate.find_matches(docs, table(spark, sf_dir, "benchmark"), only_clean=True)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data, one for an entity in all of them.

    Null and empty texts stay as they are, repeated rows get equal texts, and a text of any length is one row; further columns go on as they are, a length among them isn't counted again.  No documents give none."""
    return pii.replace_pii(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 1024 tokens.

    A null or empty text is the one id 2; repeated rows are packed each; texts of more than 1024 ids are cut into pieces.  No documents give none; columns but doc_id and text play no part."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The trained quality model and the tokenizer can't be written in SQL; tests/llm/test_pipeline.py compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written as Parquet and read again by the next.

    What a stage wrote goes once the next has been written; the documents that are packed stay in the shared folder (``lodestone-pipeline-pii-...``), for their texts and the ids of their tokens."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_cut(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
