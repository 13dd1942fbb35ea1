"""The four tables that describe an output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .entities import EntitySchema
from .rdfschema import RdfSchema
from .relations import RelationTable

ENTITIES, PROPERTIES, RELATIONS, PREDICATES = "_META_Entities", "_META_Properties", "_META_Relations", "_META_Predicates"


def predicate_metadata(spark: SparkSession, schema: RdfSchema) -> DataFrame:
    rows = [(i, p, schema.labels.get(p)) for i, p in enumerate(schema.predicates)]
    return spark.createDataFrame(rows, "predicate int not null, predicate_URI string not null, predicate_label string")


def entity_metadata(spark: SparkSession, entities: EntitySchema, schema: RdfSchema, prefix: str = "") -> DataFrame:
    rows = [(prefix + t.name, t.type, schema.labels.get(t.type), t.num_rows) for t in entities.tables]
    return spark.createDataFrame(rows, "entity_name string not null, entity_URI string not null, entity_label string, num_rows long not null")


def property_metadata(spark: SparkSession, entities: EntitySchema, schema: RdfSchema, prefix: str = "") -> DataFrame:
    """A row per property of a table, column or attribute. ``is_attribute`` is true throughout, as consumers expect; a property
    without a column has a null name and fraction kept."""
    number = {p: i for i, p in enumerate(schema.predicates)}
    rows = []
    for t in entities.tables:
        columns = {c.property.key: c for c in t.columns}
        for p in sorted({c.property for c in t.columns} | set(t.attributes), key=lambda p: p.order):
            c = columns.get(p.key)
            rows.append((prefix + t.name, number[p.predicate], c.name if c else None, c is not None, True, p.multivalued, p.ltype, p.lang, float(p.non_null), c.in_superclass if c else None))
    return spark.createDataFrame(rows, "entity_name string not null, predicate int not null, column_name string, is_column boolean not null, is_attribute boolean not null, is_multivalued boolean not null, datatype string not null, language string, non_null double, in_superclass string")


def relation_metadata(spark: SparkSession, tables: list[RelationTable], entities: EntitySchema, schema: RdfSchema, relation_prefix: str = "", entity_prefix: str = "") -> DataFrame:
    number = {p: i for i, p in enumerate(schema.predicates)}
    name = lambda t: entity_prefix + entities.type_names[t] if t is not None else None
    rows = [(relation_table_name(t, relation_prefix), name(t.from_type), name(t.to_type), number[t.predicate] if t.predicate is not None else None) for t in tables]
    return spark.createDataFrame(rows, "name string not null, from_name string, to_name string, predicate int")


def relation_table_name(table: RelationTable, prefix: str) -> str:
    """The single table has no prefix."""
    return table.name if table.from_type is None and table.predicate is None else prefix + table.name
