"""Relations between instances: resolution of object URIs and the tables of each layout."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RelationConfig, RelationStrategy
from ..functions.naming import add_retry_suffix, relation_name
from .rdfschema import ClassGraph

SINGLE_TABLE = "_relations"


@dataclass(frozen=True)
class RelationTable:
    name: str
    from_type: str | None = None
    to_type: str | None = None
    predicate: str | None = None


def selected_types(instances: DataFrame, config: RelationConfig, graph: ClassGraph) -> DataFrame:
    """id, uri, type: the types under which an instance (types: a sorted array) takes part in relations.

    One type only where the layout has no types; else, of several, those without superclasses if only roots are asked for.
    An instance whose several types all have superclasses (possible when supertypes aren't added) takes no part. The
    classes with superclasses are a frame, so their number doesn't matter to the plan.
    """
    if config.strategy in (RelationStrategy.PREDICATES, RelationStrategy.SINGLE_TABLE):
        return instances.select("id", "uri", F.col("types")[0].alias("type"))
    every = instances.select("id", "uri", F.size("types").alias("n"), F.explode("types").alias("type"))
    if not config.root_types_only or not graph.edges:
        return every.select("id", "uri", "type")
    below = graph.edge_frame(instances.sparkSession).select(F.col("sub").alias("type"), F.lit(True).alias("below")).distinct()
    return every.join(below, "type", "left").filter("n = 1 or below is null").select("id", "uri", "type")


def relation_rows(relations: DataFrame, instances: DataFrame, predicates: DataFrame, graph: ClassGraph, config: RelationConfig) -> DataFrame:
    """predicate (int), predicate_URI, from_type, from_id, to_type, to_id: the relations whose target is an instance.

    ``instances``: id, uri, types. The join on URIs is left to Catalyst; hot targets are split by AQE.
    """
    side = selected_types(instances, config, graph)
    source = relations.join(side, "uri").select(F.col("object").alias("to_uri"), F.col("predicate").alias("predicate_URI"), F.col("type").alias("from_type"), F.col("id").alias("from_id"))
    target = side.select(F.col("uri").alias("to_uri"), F.col("type").alias("to_type"), F.col("id").alias("to_id"))
    return source.join(target, "to_uri").join(predicates, "predicate_URI").select("predicate", "predicate_URI", "from_type", "from_id", "to_type", "to_id")


def clustered(rows: DataFrame) -> DataFrame:
    """Relation rows in ranges of types and predicate: a table's rows are found by the files' statistics."""
    keys = ["from_type", "to_type", "predicate_URI"]
    return rows.repartitionByRange(*keys, "from_id").sortWithinPartitions(*keys, "from_id")


def type_pairs(rows: DataFrame) -> DataFrame:
    return rows.select("from_type", "to_type").distinct()


def predicate_type_triples(rows: DataFrame) -> DataFrame:
    return rows.select("predicate_URI", "from_type", "to_type").distinct()


def distinct_predicates(rows: DataFrame) -> DataFrame:
    return rows.select("predicate_URI").distinct()


def collect_relation_schema(rows: DataFrame | None, config: RelationConfig, type_names: dict[str, str], predicate_names: dict[str, str], taken=()) -> list[RelationTable]:
    """The relation tables by name; a name that is taken gets a number instead of hiding a table."""
    s = config.strategy
    if s == RelationStrategy.NONE or rows is None:
        return []
    if s == RelationStrategy.SINGLE_TABLE:
        return [RelationTable(SINGLE_TABLE)]
    if s == RelationStrategy.PREDICATES:
        found = [RelationTable(predicate_names[r[0]], predicate=r[0]) for r in sorted(distinct_predicates(rows).collect())]
    elif s == RelationStrategy.TYPE_PREDICATES:
        found = [RelationTable(relation_name(type_names[a], predicate_names[p], type_names[b]), a, b, p) for p, a, b in sorted(tuple(r) for r in predicate_type_triples(rows).collect())]
    else:
        found = [RelationTable(relation_name(type_names[a], type_names[b]), a, b) for a, b in sorted(tuple(r) for r in type_pairs(rows).collect())]
    used, out = {t.lower() for t in taken}, []
    for t in found:
        name, i = t.name, 1
        while name.lower() in used:
            i += 1
            name = add_retry_suffix(t.name, len(t.name) + 8, i)
        used.add(name.lower())
        out.append(replace(t, name=name))
    return sorted(out, key=lambda t: t.name)


def relation_columns(table: RelationTable, type_names: dict[str, str]) -> tuple[str, str]:
    if table.from_type is None or table.to_type is None:
        return "ID_from", "ID_to"
    a, b = type_names[table.from_type], type_names[table.to_type]
    return (f"{a}_ID_from", f"{a}_ID_to") if a == b else (f"{a}_ID", f"{b}_ID")


def relation_frame(table: RelationTable, rows: DataFrame, config: RelationConfig, type_names: dict[str, str]) -> DataFrame:
    a, b = relation_columns(table, type_names)
    for column, value in (("from_type", table.from_type), ("to_type", table.to_type), ("predicate_URI", table.predicate)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    keep_predicate = config.store_predicate and table.predicate is None
    return rows.select(F.col("from_id").alias(a), F.col("to_id").alias(b), *(["predicate"] if keep_predicate else []))
