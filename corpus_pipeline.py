"""A training corpus from ``documents``: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicelens.llm.common import discard, read, stage
from slicelens.llm.line_dedup import strip_boilerplate
from slicelens.llm.mixing import mix_documents
from slicelens.llm.ngram_join import jaccard_components
from slicelens.llm.sentencepiece import encode_checked
from slicelens.llm.toxicity import fit_toxicity, toxicity_score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; the model learns from ``labels``.

    A null text scores as an empty one. Rows that repeat an id are scored each by its own text.
    """
    model = fit_toxicity(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return docs.filter(toxicity_score(F.col("text"), model) < 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; those that lose every line go.

    A boilerplate line stays in its first document, so a document that loses
    all of them holds nothing of its own. ``n_chars`` follows the text.
    """
    clean = strip_boilerplate(docs).filter("n_removed = 0 OR n_removed < n_lines")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    changed = F.col("n_removed") > 0
    return clean.select(
        *[
            F.when(changed, new[c]).otherwise(F.col(f"doc.`{c}`")).alias(c) if c in new
            else F.col(f"doc.`{c}`").alias(c)
            for c in docs.columns
        ]
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: five-word shingles, similarity 0.8 or more.

    The smallest id stays. Of rows with this id and one text the first by all
    columns stays; another text under the same id stays too. Rows without id all stay.
    """
    found = jaccard_components(docs.select("doc_id", "text"))
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.filter("doc_id IS NOT NULL").select(F.struct(*names).alias("doc"))
    # Always a shuffle join: the ids grow with the documents.
    once = (
        rows.join(kept.hint("merge"), F.col("doc.doc_id") == F.col("id"), "left_semi")
        .groupBy(F.col("doc.doc_id").alias("id"), F.md5(F.col("doc.text").cast("binary")).alias("text"))
        .agg(F.min("doc").alias("doc")).select("doc.*")
    )
    return once.union(docs.filter("doc_id IS NULL").select(*names))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a 5-2-1 mix of their sources takes them.

    A null source is a source of its own, the last; a null text has no words and is never taken.
    Rows that repeat an id are taken each for itself.
    """
    return mix_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens, restored``: SentencePiece ids, and whether they decode to the text."""
    return encode_checked(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("sentencepiece", pieces),
]

#: The classifier and the hash order of the near copies' join have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written and read again.

    A result is removed once the next stage has been written.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
