"""A training corpus from documents, in five stages; each works on all that the stage before it kept.

No stage's result can be stated in SQL as a whole (learned scores, fingerprints, drawn mixes), so ORACLE_SQL is None
and the stages are tested against brute force and exact round trips.

All stages but the last return the columns of documents as they got them, whatever more there are and whatever they
are called; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import mixing, near_copies, pieces, substring, toxicity
from corpusmill.llm.shared import forget, free_name, keep, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts get the score of the intercept, equal texts the same score; rows without a doc_id are scored, never learned from.
    """
    score = free_name(docs.columns, "score")
    scored = toxicity.scored(docs, table(spark, sf_dir, "labels"), score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose five-word shingles are alike to 0.8 one row stays: that with the smallest doc_id, nulls last.

    Null and empty texts, and those of white space only, are copies of each other; rows without a doc_id are compared like any others;
    of rows that share a doc_id each stands for itself, ties go by a hash of the text, and of equal rows one stays.
    """
    return near_copies.first_of_near_copies(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go, and rows that lose all their words; n_chars follows.

    Null, empty and short texts stay as they are, and so do rows without a doc_id and what only rows of one doc_id share.
    """
    return substring.deduplicated(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to their target weights; a row for each time a document is taken.

    Null and empty texts have no words and fit every mix; a null source is one source; equal rows are taken or passed over together.
    """
    return mixing.mixed(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become SentencePiece ids, in a column ids (ids_, if docs have one of that name); null and empty texts have none."""
    return pieces.encode(docs, pieces.default_model(), free_name(docs.columns, "ids"))


STAGES = [("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("substring_dedup", substring_stage), ("source_mix", mix_stage), ("sentencepiece", encode_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another; a stage's table goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            forget(before)
        before = docs
    return docs
