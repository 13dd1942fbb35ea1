"""A training-corpus pipeline over ``documents``: five stages, each written and read again before the next.

language     rows whose language isn't one of the accepted ones go
line_dedup   later repeated runs of lines go; a document of which nothing is left goes
near_dedup   one document of each class of near copies stays: the one of least id
decontaminate  documents that hold a window of eight words of a benchmark item, or a shorter item whole, go
pack         the rest is tokenised and packed into sequences of 1024 tokens

Each function takes (spark, docs, sf_dir). Rows are told apart by id and text, so rows that share an id are judged each on
its own text; of rows equal in both, near_dedup keeps one. Null ids are like any other. Null and empty texts have no
language and go in the first stage; a later stage that is given them keeps them (near_dedup: all rows of the null text that
have ids of their own; decontaminate: they hold no window; pack: one sequence place for the closing id). Ties between copies
go to the least id, then the least text hash. An empty table stays empty in every stage, and a very long text is read
whole. Extra columns, whatever their names, are carried along up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import drop_rows, fresh, materialise, one_of_each, read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from quadloom.llm.language import identify_documents

    keys = {"id": F.col("doc_id"), "t": F.xxhash64("text")}
    judged = materialise(identify_documents(docs, keys).filter("not kept").select("id", "t").distinct(), "rejected")
    return drop_rows(docs, list(keys.values()), judged)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from quadloom.llm.line_dedup import dedup_lines

    lines, removed = fresh(docs, "_n_lines", "_n_removed")
    out = dedup_lines(docs, counts=(lines, removed))
    gone = (F.col(removed) > 0) & (F.trim(F.translate("text", "\n\r\t", "   ")) == "")
    out = out.filter(~F.coalesce(gone, F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from quadloom.llm.near_dedup import near_classes

    keys = [F.col("doc_id"), F.xxhash64("text")]
    extra = materialise(near_classes(docs).filter("id <> root").select("id.i", "id.t"), "copies")
    return one_of_each(drop_rows(docs, keys, extra), keys)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from quadloom.llm.decontaminate import without_matches

    return without_matches(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from quadloom.llm.packing import pack_documents

    return pack_documents(docs)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: SQL can't express the fitted language model, the signatures or the tokenizer; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
