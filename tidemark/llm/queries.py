"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import alignment, embedding_dedup, exact_dedup, html_wrappers, importance, language_id, minhash_dedup, mixing, packing, sharding, substring_dedup, toxicity, url_rules
from tidemark.llm.storage import table


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op1(table(spark, sf_dir, "documents"))


def op2_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op3(table(spark, sf_dir, "documents"))


def op4_union_free_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(table(spark, sf_dir, "pages"))


def op5_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op5(table(spark, sf_dir, "documents"))


def op6_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op6(table(spark, sf_dir, "documents"))


def op7_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op10(table(spark, sf_dir, "documents"))


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.verdicts(table(spark, sf_dir, "pages"), mined=url_rules.MINED)  # as its SQL


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.op12(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_virtual_slots, op2_chunk_recipes, op3_pareto_mix, op4_union_free_wrappers, op5_suffix_automata, op6_hyperdimensional_language, op7_kneser_ney_toxicity, op8_pca_tiles, op9_circulant_minhash, op10_best_two_fit, op11_url_rules, op12_cross_tokenizer, op13_importance_resampling)}
ORACLE_SQL: dict[str, str] = {"op2_chunk_recipes": exact_dedup.ORACLE_SQL, "op3_pareto_mix": mixing.oracle_sql(), "op5_suffix_automata": substring_dedup.ORACLE_SQL, "op8_pca_tiles": embedding_dedup.ORACLE_SQL, "op9_circulant_minhash": minhash_dedup.ORACLE_SQL, "op11_url_rules": url_rules.oracle_sql(), "op13_importance_resampling": importance.ORACLE_SQL}
