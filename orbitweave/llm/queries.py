"""The queries of this subpackage: op1 to op13, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.llm import conversation_repair, fill_in_middle, line_dedup, quality_rules, topk, warc
from orbitweave.llm.bpe import encoded_digests
from orbitweave.llm.licences import licence_scan
from orbitweave.llm.mixing import mixture
from orbitweave.llm.pii import personal_data
from orbitweave.llm.rule_ensemble import quality_scores
from orbitweave.llm.simhash import near_duplicates
from orbitweave.llm.wrappers import extract

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector whose id is divisible by 50 against all others; nulls, repeats and empty tables as in :func:`topk.top_k`."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and copies of every document; nulls, repeats and empty tables as in :func:`mixing.mixture`."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token digests of every whole text; nulls, repeats and empty tables as in :func:`bpe.encode`."""
    return encoded_digests(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; nulls, repeats and empty tables as in :func:`wrappers.extract`."""
    return extract(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; nulls, repeats and empty tables as in :func:`quality_rules.quality_rules`."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("left_share")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in every whole text; nulls, repeats and empty tables as in :func:`licences.licence_scan`."""
    return licence_scan(table(spark, sf_dir, "documents")).drop("matches")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text; nulls, repeats and empty tables as in :func:`pii.personal_data`."""
    return personal_data(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every whole text; nulls, repeats and empty tables as in :func:`rule_ensemble.quality_scores`."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC files against a spoilt replica; nulls, repeats and empty tables as in :func:`warc.fixity_audit`."""
    pages = table(spark, sf_dir, "pages")
    return warc.fixity_audit(pages, warc.bit_rot)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; nulls, repeats and empty tables as in :func:`simhash.near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired; nulls, repeats and empty tables as in :func:`conversation_repair.conversation_repair`."""
    return conversation_repair.conversation_repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and digests of every document; nulls, repeats and empty tables as in :func:`fill_in_middle.fill_in_middle`."""
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    again = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(again).alias("restored_sha256"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document and those it loses; nulls, repeats and empty tables as in :func:`line_dedup.line_dedup`."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_topk_search, op2_mixing, op3_bpe, op4_html_extraction, op5_quality_rules,
        op6_licence_scan, op7_pii, op8_quality_classifier, op9_warc_audit, op10_simhash_near_dedup,
        op11_conversation_repair, op12_fill_in_middle, op13_line_dedup,
    )
}

SQL: dict[str, str] = {"op1_topk_search": topk.SQL, "op5_quality_rules": quality_rules.SQL, "op9_warc_audit": warc.SQL, "op12_fill_in_middle": fill_in_middle.SQL, "op13_line_dedup": line_dedup.SQL}
