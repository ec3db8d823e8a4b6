"""A corpus pipeline over the documents table: each stage reads what its predecessor kept.

1. quality classifier: documents that it rejects go;
2. line dedup: lines that stand on too many documents of one source go;
3. n-gram Jaccard join: of each group of near duplicates one document stays;
4. benchmark decontamination: documents in which a benchmark item occurs go;
5. packing: the documents as pieces of token sequences.

The stages before the last return the columns of documents; n_chars follows the text. A stage's extra columns are dropped.
Null and empty texts, repeated rows and empty tables are treated as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.llm.common import read, small_batches, table_in_shared_folder
from pointmill.llm.decontamination import clean
from pointmill.llm.line_dedup import line_dedup
from pointmill.llm.near_duplicates import one_of_each_group
from pointmill.llm.packing import pack
from pointmill.llm.quality import keep_good

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A site's boilerplate stands on about a tenth of its pages, by chance on 8 to 14 %, and other lines on under 5 %.
BOILERPLATE_RATIO = 0.06
#: Two pages with a line may be copies of one document, which the next stage joins.
BOILERPLATE_PAGES = 3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup(docs, max_ratio=BOILERPLATE_RATIO, min_pages=BOILERPLATE_PAGES)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


def _in_small_batches(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality", _in_small_batches(quality)),
    ("line_dedup", _in_small_batches(lines)),
    ("near_duplicates", _in_small_batches(near_duplicates)),
    ("decontamination", _in_small_batches(decontamination)),
    ("packing", _in_small_batches(packing)),
]

#: SQL can't express learnt scores, MinHash pruning, alignment or tokenizing: the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents table."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = table_in_shared_folder(docs, f"stage-{name}")
    return docs
