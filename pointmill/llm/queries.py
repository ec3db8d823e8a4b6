"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointmill.llm import filter_audit, licences, rules
from pointmill.llm import line_dedup as lines
from pointmill.llm.common import read, small_batches
from pointmill.llm.decontamination import contamination
from pointmill.llm.fingerprints import fingerprints
from pointmill.llm.html_text import extract
from pointmill.llm.language import identify
from pointmill.llm.near_duplicates import jaccard_join
from pointmill.llm.packing import pack
from pointmill.llm.quality import quality
from pointmill.llm.token_alignment import token_alignment
from pointmill.llm.toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents")).drop("text_hash")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_hash")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


def _in_small_batches(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


_OWN: dict[str, Query] = {
    "op1_html_text": op1_html_text,
    "op2_toxicity": op2_toxicity,
    "op3_language": op3_language,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_decontamination": op7_decontamination,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality": op9_quality,
    "op10_licences": op10_licences,
    "op11_alignment": op11_alignment,
    "op12_filter_audit": op12_filter_audit,
    "op13_fingerprints": op13_fingerprints,
}

QUERIES: dict[str, Query] = {name: _in_small_batches(query) for name, query in _OWN.items()}

ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": rules.ORACLE_SQL,
    "op8_line_dedup": lines.ORACLE_SQL,
    "op10_licences": licences.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
}
