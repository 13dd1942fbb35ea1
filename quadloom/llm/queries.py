"""The driver's queries of the ten operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shared_dir

SHARDS = 40


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_spans

    return secret_spans(read_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify_documents

    return identify_documents(read_table(spark, sf_dir, "documents"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over raw pages, with markup and addresses as evidence."""
    from .language import identify_pages

    return identify_pages(read_table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).drop("longest_match", "match_item", "match_start")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def longest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document that holds a window: its longest verbatim match with the benchmark and where it stands."""
    return _matches(spark, sf_dir).filter("n_items > 0").select("doc_id", "longest_match", "match_item", "match_start")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dedup

    return near_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_pages

    return extract_pages(read_table(spark, sf_dir, "pages"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_column

    return media_column(read_table(spark, sf_dir, "documents"), with_pcm=True)


def media_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 7 stores, read back, without the decoded signal: the part that SQL can follow."""
    from .media import media_column

    return media_column(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir)


def _rollup(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Toxic documents are withdrawn after they were counted."""
    from .rollup import rollup_documents

    toxic = read_table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return rollup_documents(read_table(spark, sf_dir, "documents"), toxic, f"{shared_dir(spark)}/quadloom/rollup-{uuid.uuid4().hex}", **options)


def rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches for the version that SQL can count as well."""
    return _rollup(spark, sf_dir, versions=("words",))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import Topology, shard_documents

    return shard_documents(read_table(spark, sf_dir, "documents"), Topology.uniform(SHARDS))


def queries() -> dict:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return found | {f.__name__: f for f in (language_id_pages, longest_matches, media_stored, rollup_words)}


def oracle_sql() -> dict[str, str]:
    from .oracles import oracle_sql

    return oracle_sql()
