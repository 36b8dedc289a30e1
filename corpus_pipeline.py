"""A training corpus from raw documents: judge, drop common lines, drop near copies, drop repeated passages, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; what it returns is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents. SQL can't express the
stages (a forest, a tokenizer), so ORACLE_SQL is None and the tests hold run() against brute force.

Cases, for all stages: columns besides those of documents are left out, whatever their names; an empty table gives no rows;
rows that repeat an id and a text stay or go together; a null id counts as the largest one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowprep.llm.common import scratch, table, written
from flowprep.llm.jaccard import one_of_each
from flowprep.llm.lines import drop_lines
from flowprep.llm.packing import pack
from flowprep.llm.passages import drop_passages
from flowprep.llm.quality import keep_good

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def measured(docs: DataFrame) -> DataFrame:
    """n_chars as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the forest reject go: with them null, empty and very short texts. Very long ones are judged
    like others; documents without a label are judged by the threshold that labelled ones set."""
    return keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; a text of nothing else is left empty, a null one null."""
    return measured(drop_lines(docs.select(*COLUMNS)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies stays, as do documents without words, which have no copies."""
    return one_of_each(docs.select(*COLUMNS))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 words that a document of a smaller id has go; texts that lose none are left as they are, of the others the words
    that stay are joined by blanks."""
    return measured(drop_passages(docs.select(*COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in as few sequences as best fit gives: a row a piece, an empty text is one of a single token."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", near_copies), ("substring dedup", passage_dedup), ("best-fit packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as keep:  # tables of earlier stages go at the end, each stage's own with it
        for name, stage in STAGES:
            with scratch(spark) as hand_on:
                docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
                hand_on(docs)
        keep(docs)
    return docs
