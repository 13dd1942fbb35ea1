"""Entity schema inference, entity tables and the attribute table.

Statistics are two aggregates; the decision which property becomes a column is made on the driver over one row per (type,
property). Ties are broken by predicate URI, type and language, so the schema never depends on the data's layout.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EntityConfig
from ..functions.naming import add_language_suffix, add_retry_suffix, add_type_suffix
from ..functions.xsd import SPARK_TYPES, typed
from .rdfschema import ClassGraph

RESERVED = ("ID", "URI")
EAV_TABLE = "_attributes"


@dataclass(frozen=True)
class Property:
    predicate: str
    ltype: str
    lang: str | None
    multivalued: bool
    non_null: float

    @property
    def key(self) -> tuple[str, str, str | None]:
        return (self.predicate, self.ltype, self.lang)

    @property
    def order(self) -> tuple:
        return (-self.non_null, self.predicate, self.ltype, self.lang or "")


@dataclass(frozen=True)
class ColumnOf:
    name: str
    property: Property
    in_superclass: str | None = None  # where an ancestor's table stores it: table.column


@dataclass(frozen=True)
class EntityTable:
    name: str
    type: str
    num_rows: int
    columns: tuple[ColumnOf, ...]
    attributes: tuple[Property, ...]

    @property
    def stored(self) -> tuple[ColumnOf, ...]:
        return tuple(c for c in self.columns if c.in_superclass is None)


@dataclass
class EntitySchema:
    tables: list[EntityTable]
    type_names: dict[str, str]
    predicate_names: dict[str, str]
    by_type: dict[str, EntityTable] = field(init=False)

    def __post_init__(self) -> None:
        self.by_type = {t.type: t for t in self.tables}


def count_by_type(types: DataFrame) -> DataFrame:
    return types.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def facts_by_type(members: DataFrame, literals: DataFrame) -> DataFrame:
    """type, id, uri and each literal of a member (predicate, ltype, lang, values; null for a member without any), clustered by type.

    One join for all tables: written in ranges of (type, id), so that a table's rows are found by the files' statistics
    and a type of any size is spread over many ranges.
    """
    joined = members.join(literals, "uri", "left").select("type", "id", "uri", "predicate", "ltype", "lang", "values")
    return joined.repartitionByRange("type", "id").sortWithinPartitions("type", "id")


def stats_of(facts: DataFrame) -> DataFrame:
    """``property_stats`` of the rows of ``facts_by_type``."""
    return facts.filter("predicate is not null").groupBy("type", "predicate", "ltype", "lang").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.size("values") > 1).alias("multivalued"))


def property_stats(types: DataFrame, literals: DataFrame) -> DataFrame:
    """(type, predicate, ltype, lang): n instances that have it, and whether any has several values."""
    return literals.join(types, "uri").groupBy("type", "predicate", "ltype", "lang").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.size("values") > 1).alias("multivalued"))


def split_properties(properties: list[Property], config: EntityConfig) -> tuple[list[Property], list[Property]]:
    """(columns, attributes): frequent properties are columns up to the limit; rare, multivalued and surplus ones attributes."""
    ordered = sorted(properties, key=lambda p: p.order)
    columns = [p for p in ordered if p.non_null >= config.min_non_null_fraction]
    surplus = columns[config.max_columns :] if config.max_columns is not None else []
    columns = columns[: config.max_columns] if config.max_columns is not None else columns
    attributes = [p for p in ordered if config.redundant_eav or p.multivalued or p.non_null < config.min_non_null_fraction or p in surplus]
    return columns, attributes


def name_columns(columns: list[Property], predicate_names: dict[str, str], config: EntityConfig, max_length: int, reserved=()) -> list[ColumnOf]:
    """Unique column names: a clash gets the type's suffix, and a number if that clashes too."""
    used = {r.lower() for r in (*RESERVED, *reserved)}
    out = []
    for p in columns:
        base = add_language_suffix(predicate_names[p.predicate], p.lang)
        name = add_type_suffix(base, p.ltype) if config.force_type_suffix or base.lower() in used else base
        i, stem = 1, name
        while name.lower() in used:
            i += 1
            name = add_retry_suffix(stem, max(max_length, len(stem)), i)
        used.add(name.lower())
        out.append(ColumnOf(name, p))
    return sorted(out, key=lambda c: c.name) if config.sort_columns else out


def mark_inherited(tables: list[EntityTable], graph: ClassGraph) -> list[EntityTable]:
    """Columns that a superclass's table stores are marked with where; the topmost such table wins."""
    by_type = {t.type: t for t in tables}
    order = [c for c in graph.super_class_first() if c in by_type]
    for c in order:
        above = graph.super_classes(c)
        supers = [by_type[s] for s in order if s in above]
        places = {}
        for t in reversed(supers):
            places.update({x.property.key: x.in_superclass or f"{t.name}.{x.name}" for x in t.columns})
        by_type[c] = replace(by_type[c], columns=tuple(replace(x, in_superclass=places.get(x.property.key)) for x in by_type[c].columns))
    return [by_type[t.type] for t in tables]


def collect_entity_schema(counts: dict[str, int], stats: DataFrame, graph: ClassGraph, type_names: dict[str, str], predicate_names: dict[str, str], config: EntityConfig, max_column_length: int = 50, reserved=()) -> EntitySchema:
    """``counts``: instances by type; ``stats``: a row per type and property, which is what the driver decides on."""
    found: dict[str, list[Property]] = {}
    for r in stats.collect():
        found.setdefault(r["type"], []).append(Property(r["predicate"], r["ltype"], r["lang"], r["multivalued"], r["n"] / counts[r["type"]]))
    tables = []
    for t, n in counts.items():
        if n >= config.min_rows:
            columns, attributes = split_properties(found.get(t, []), config)
            tables.append(EntityTable(type_names[t], t, n, tuple(name_columns(columns, predicate_names, config, max_column_length, reserved)), tuple(attributes)))
    tables.sort(key=lambda t: t.name)
    if not config.redundant_subclass_columns:
        tables = mark_inherited(tables, graph)
    return EntitySchema(tables, type_names, predicate_names)


def _same_key(p: Property) -> Column:
    lang = F.col("lang").isNull() if p.lang is None else F.col("lang") == p.lang
    return (F.col("predicate") == p.predicate) & (F.col("ltype") == p.ltype) & lang


def _not_null(frame: DataFrame, *names: str) -> DataFrame:
    """``frame`` whose columns ``names`` are declared not null (they hold no nulls)."""
    schema = T.StructType([T.StructField(f.name, f.dataType, f.nullable and f.name not in names) for f in frame.schema])
    return frame.to(schema) if not any(f.nullable for f in frame.schema if f.name in names) else frame.select(*[F.coalesce(F.col(f"`{f.name}`"), _zero(f)).alias(f.name) if f.name in names and f.nullable else F.col(f"`{f.name}`") for f in frame.schema])


def _zero(f: T.StructField) -> Column:
    return F.lit("" if isinstance(f.dataType, T.StringType) else 0).cast(f.dataType)


def entity_frame(table: EntityTable, facts: DataFrame) -> DataFrame:
    """ID, URI and the stored columns of a table: one aggregate over its own rows of ``facts_by_type``. Of several values the least is shown."""
    rows = facts.filter(F.col("type") == table.type)
    least = [F.min(F.when(_same_key(c.property), _least_value(c.property.ltype))).alias(c.name) for c in table.stored]
    found = rows.groupBy("id", "uri").agg(*least) if least else rows.select("id", "uri").distinct()
    return _not_null(found.select(F.col("id").alias("ID"), F.col("uri").alias("URI"), *[F.col(f"`{c.name}`") for c in table.stored]), "ID", "URI")


def _least_value(ltype: str) -> Column:
    return F.array_min(F.transform("values", lambda v: typed(v, ltype)))


def subclass_first(tables: list[EntityTable], graph: ClassGraph) -> list[EntityTable]:
    """The order in which tables can be overwritten without breaking foreign keys."""
    place = {c: i for i, c in enumerate(graph.super_class_first())}
    return sorted(tables, key=lambda t: (-place.get(t.type, -1), t.name))


def attribute_frame(schema: EntitySchema, facts: DataFrame, predicates: DataFrame) -> DataFrame:
    """ID, predicate, datatype, language, value: literals that are an attribute of at least one of their instance's tables.

    The rows of ``facts_by_type`` are kept by the small table of attributes, then each literal counts once.
    """
    keys = sorted({(t.type, p.predicate, p.ltype, p.lang or "") for t in schema.tables for p in t.attributes})
    wanted = facts.sparkSession.createDataFrame(keys, "type string, predicate string, ltype string, tag string")
    rows = facts.filter("predicate is not null").withColumn("tag", F.coalesce("lang", F.lit(""))).join(wanted, ["type", "predicate", "ltype", "tag"], "left_semi")
    rows = rows.dropDuplicates(["id", "predicate", "ltype", "tag"]).select("id", F.col("predicate").alias("predicate_URI"), "ltype", "lang", F.explode("values").alias("value"))
    out = rows.join(predicates, "predicate_URI").select(F.col("id").alias("ID"), "predicate", F.col("ltype").alias("datatype"), F.col("lang").alias("language"), "value")
    return _not_null(out, "ID", "predicate", "value")


def data_type(ltype: str) -> T.DataType:
    return SPARK_TYPES[ltype]
