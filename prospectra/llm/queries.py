"""Queries and oracle SQL of the corpus operators, for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_blocks, langid, line_dedup, lm_automaton, mixing, periodic, quality, simhash, token_files, toxicity, url_trust, whitening
from .common import read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_automaton.score(read_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.selectExpr("doc_id", "_n_lines AS n_lines", "_n_removed AS n_removed", "text")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: Fixed values of the query's contract.
URL_RULES = [
    url_trust.Rule("com", "/en/", "block"),
    url_trust.Rule("example.com", "/en/7", "allow"),
    url_trust.Rule("net", "/de/", "allow"),
    url_trust.Rule("example.net", "/de/8", "block"),
    url_trust.Rule("org", "/es/", "block"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).drop("source")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(read_table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(read_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(read_table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_lm_score": op2_lm_score,
        "op3_line_dedup": op3_line_dedup,
        "op4_decontamination": op4_decontamination,
        "op5_url_filter": op5_url_filter,
        "op6_mixing": op6_mixing,
        "op7_html_extraction": op7_html_extraction,
        "op8_quality_rules": op8_quality_rules,
        "op9_language_id": op9_language_id,
        "op10_simhash": op10_simhash,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_token_files": op12_token_files,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.ORACLE, "op4_decontamination": decontam.ORACLE, "op6_mixing": mixing.ORACLE}
