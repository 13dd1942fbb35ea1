"""Relational tables as quads: every row a subject, columns its literals and keys its relations.

``columns`` of a ``Mapping`` become literals, ``links`` relations. A table is read once: its quads come from one generator
over an array of statements, not from one scan per column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RDF_TYPE, RDFS_LABEL, RDFS_SUBCLASS
from ..functions.xsd import XSD
from .nquads import QUAD_COLUMNS

BASE = "http://ex.org/"


@dataclass
class Mapping:
    """How a table's rows become statements; expressions are SQL over the table's columns."""

    subject: str
    types: list[str] = field(default_factory=list)
    literals: list[tuple[str, str, str | None, str | None]] = field(default_factory=list)  # predicate, value, datatype, language
    links: list[tuple[str, str]] = field(default_factory=list)  # predicate, object


def _statement(p: str, o: Column, kind: str, datatype: Column | None = None, lang: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), (datatype if datatype is not None else none).alias("o_datatype"), (lang if lang is not None else none).alias("o_lang"))


def triplify(table: DataFrame, mapping: Mapping, graph: str | None = BASE + "g") -> DataFrame:
    """The table's quads; null values make no statement."""
    parts = [_statement(RDF_TYPE, F.expr(t), "uri") for t in mapping.types]
    parts += [_statement(p, F.expr(v), "literal", F.lit(XSD + d) if d else None, F.expr(lang) if lang else None) for p, v, d, lang in mapping.literals]
    parts += [_statement(p, F.expr(o), "uri") for p, o in mapping.links]
    rows = table.select(F.expr(mapping.subject).alias("s"), F.explode(F.array(*parts)).alias("x")).select("s", "x.*").filter("o is not null")
    return rows.withColumns({"s_kind": F.lit("uri"), "g": F.lit(graph)}).select(*QUAD_COLUMNS)


def subclass_quads(spark, pairs: list[tuple[str, str]]) -> DataFrame:
    return _constant(spark, [(a, RDFS_SUBCLASS, b, "uri") for a, b in pairs])


def label_quads(spark, pairs: list[tuple[str, str]]) -> DataFrame:
    return _constant(spark, [(a, RDFS_LABEL, b, "literal") for a, b in pairs])


def _constant(spark, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    frame = spark.createDataFrame(rows, "s string, p string, o string, o_kind string")
    return frame.withColumns({"s_kind": F.lit("uri"), "o_datatype": F.lit(None).cast("string"), "o_lang": F.lit(None).cast("string"), "g": F.lit(None).cast("string")}).select(*QUAD_COLUMNS)
