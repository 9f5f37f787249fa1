"""The corpus pipeline: documents in, a deduplicated, decontaminated and mixed corpus out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and works on all
that its predecessor kept. All but the last return the columns of ``documents``.

1. toxicity: documents that the classifier scores at 0.5 or above go.
2. line_dedup: lines found in at least 10 documents go from every text.
3. near_dedup: one document of each group of near-duplicates stays (five words, 0.8).
4. decontamination: documents that hold ten consecutive words of a benchmark item go.
5. mixing: sources are sampled to their target weights; a document that is taken twice is
   two rows, numbered in ``repetition``.

Defined results, besides those of each stage below: an empty table comes out empty; a text of
any length is worked on whole; columns beyond those of ``documents`` pass through, also where
their names are those that operators compute, two underscores in front or not (a column ``repetition`` is
replaced by the mix's).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomry.llm import op03_mix, op06_toxic, op08_near, op09_decontam, op10_lines
from fathomry.llm._work import Work, cleared

#: A trained classifier is the first stage, which SQL can't express.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that score below 0.5.

    Where no text of docs is labelled, or all that are have the same label, or none of them fits the bound on training
    bytes, there is no classifier and every row stays. A null or empty text scores as the intercept, which is
    below 0.5 where most labels are 0; repeated rows go or stay together; a null doc_id is scored like any other.
    """
    return op06_toxic.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the lines that at least 10 of them hold; ``n_chars`` follows the text.

    Every row stays, with an empty text if all its lines go; a null text stays null; empty lines
    stay; a line counts once for a row, and repeated rows count each.
    """
    return op10_lines.drop_lines(docs, op10_lines.build_index(Work(spark, "pipeline-lines"), docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of near-duplicates, one row a doc_id and text.

    Texts without words (or null) are like nothing and stay; rows without a doc_id stay; texts
    that share a doc_id are documents of their own.
    """
    return op08_near.keep_one(Work(spark, "pipeline-near"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs in which no window of a benchmark item stands.

    Null and word-less texts stay; an item of fewer than ten words is one window, one without
    words none; a document with a null doc_id or a repeated one is judged by its own text.
    """
    return op09_decontam.drop_contaminated(Work(spark, "pipeline-decontam"), docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix takes them, with ``repetition`` from 0.

    A null source is a source of its own; a text without words has size 0 and is taken with its
    source's whole repetitions; of equal rows as many are taken once more as fit the target.
    """
    return op03_mix.mix(Work(spark, "pipeline-mix"), docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, and a stage's own tables go when it ends."""
    work, docs = Work(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        with cleared():
            docs = work.save(stage(spark, docs, sf_dir), name)
        if i:
            work.drop(STAGES[i - 1][0])
    return docs
