"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Between
stages the rows are written as Parquet and read again, so a lost executor repeats one stage at
most. All stages but the last return the columns of ``documents``.

All stages: nulls in any column are allowed (a null text counts as empty, a null doc_id as an id of
its own per row), texts are read whole whatever their length, an empty table gives an empty table, and
columns beyond those of ``documents`` are handed on untouched by all stages but the last, whatever
their names. Each stage says what becomes of empty texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandweave.llm import decontam, langid, neardup, packing, quality
from strandweave.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language stay (see ``langid.keep_known``): texts that are null, empty or
    without letters go, and those most of whose n-grams no learned text has. Repeated rows stay or go
    together; a tie between languages does not matter."""
    return langid.keep_known(docs, langid.train(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more stay, exactly 0.5 included. An empty text
    is scored by its statistics as any other. Repeated rows stay or go together."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the least doc_id, and one of repeated
    rows (see ``neardup.keep_one``). Texts without words are no one's duplicates; rows without an id
    all stay."""
    return neardup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with 5 % or more benchmark words go, exactly 5 % included; from others benchmark
    passages are cut. Texts without words stay as they are; repeated rows are treated alike."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 1024 ids (see ``packing.pack``). An empty
    text is one id, its separator; repeated rows are packed each; ties in length go by doc_id."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("quality", good),
    ("near-duplicates", distinct),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Trained models and a tokenizer have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again: pieces of packed documents. An empty
    table gives no pieces; nulls, ties and repeated rows as in the stages."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
