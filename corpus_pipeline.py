"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``; rows may have
nulls in any column, repeat, or have empty texts, as the operators' docstrings say for each.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrowick.llm.common import Workspace, marked, read, release
from ferrowick.llm.decontaminate import drop_contaminated
from ferrowick.llm.jaccard_join import keep_one_of_each
from ferrowick.llm.line_dedup import dedup_lines
from ferrowick.llm.packing import MAX_LOSS, pack
from ferrowick.llm.subword import keep_quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """A stage hands on the workspaces that its result reads by name, in the metadata of the result's columns.

    The next stage gets them with the written table and removes them: those of its own predecessor and no others.
    """

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        docs = release(docs)
        with Workspace.collecting() as made:
            out = f(spark, docs, sf_dir)
        return marked(out, made)

    return run


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword classifier rejects go."""
    return keep_quality(docs, read(spark, sf_dir, "labels"))


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document that consists of nothing else goes with them."""
    out = dedup_lines(docs)
    cut = out.columns[-1]
    out = out.where((F.col(cut) == 0) | (F.col("text") != ""))
    return out.withColumn("n_chars", F.when(F.col(cut) == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity 0.8 or more."""
    return keep_one_of_each(docs)


@stage
def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, re-parameterised ones included, go."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences under three limits, with their token ids: the texts that are left can be read back from them."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), max_loss=MAX_LOSS, head_is_prompt=True)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("leaks", leaks), ("packing", packing)]
ORACLE_SQL = None  # line runs, trained scores and packing are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = ws.save(docs, name, "snappy")
            if k:
                ws.drop(STAGES[k - 1][0])
    return docs
