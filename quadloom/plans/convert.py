"""The convert job: quads to entity, attribute, relation and metadata tables.

Frames stay lazy until a sink writes them. The driver sees three small things, as they decide what tables there are: the
class edges, the statistics of types and properties, and the distinct relation types or predicates.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ConvertConfig, RelationStrategy
from ..functions.naming import format_names
from ..operators import metadata as M
from ..operators.entities import EAV_TABLE, EntitySchema, attribute_frame, collect_entity_schema, count_by_type, entity_frame, facts_by_type, stats_of, subclass_first
from ..operators.facts import classify, facts_of
from ..operators.filters import filter_instances, filter_quads, has_type
from ..operators.flavors import flavor as find_flavor
from ..operators.ids import dense_ids, partition_by_type
from ..operators.rdfschema import RdfSchema, collect_schema
from ..operators.relations import RelationTable, clustered, collect_relation_schema, relation_columns, relation_frame, relation_rows
from ..session import keep, keep_written, materialise
from ..sinks import Persistor, persistor
from ..sinks.persistors import Manifest
from ..sources.nquads import accepted_language, read_quads


@dataclass
class Conversion:
    """Everything between the quads and the tables."""

    schema: RdfSchema
    instances: DataFrame  # id, uri, types
    facts: DataFrame  # of facts_by_type
    entities: EntitySchema
    relation_rows: DataFrame | None
    relation_tables: list[RelationTable]
    predicates: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    manifest: Manifest = field(default_factory=Manifest)
    bad_records: DataFrame | None = None


def analyse(spark: SparkSession, quads: DataFrame, config: ConvertConfig | None = None, reserved=frozenset()) -> Conversion:
    """Infer the schemas of an output; no table is computed yet. The source is read once: what its statements are is written, and all else reads that."""
    config = config or ConvertConfig()
    config.quads.validate()
    own = find_flavor(config.flavor)
    quads = own.modify_quads(accepted_language(quads, tuple(config.parser.accepted_languages)))
    if config.instance_partitions:
        quads = quads.repartition(config.instance_partitions)
    judged = lambda q: materialise(classify(q, config.rdf.all_type_predicates, config.instances.default_language), "statements")
    if config.quads.resources or config.quads.blacklist:  # the schema is that of all quads
        quads = materialise(quads, "quads")
        schema = collect_schema(quads, config.rdf)
        statements = judged(keep(filter_quads(quads, config.quads), config.filter_cache_level))
    else:
        statements = judged(quads)
        schema = collect_schema(statements, config.rdf)
    facts = facts_of(statements, schema.graph, config.instances)
    literals = materialise(facts.literals, "literals")
    kept = has_type(filter_instances(facts.instances, config.instances_filter, schema.types))
    instances = dense_ids(kept)
    if config.instances.repartition_by_type:
        instances = partition_by_type(instances, int(spark.conf.get("spark.sql.shuffle.partitions")))
    instances = keep_written(materialise(instances, "instances"), config.cache_level)
    by_type = keep_written(materialise(facts_by_type(instances.select("id", "uri", F.explode("types").alias("type")), literals), "by-type"), config.cache_level)

    naming = config.naming
    names = schema.labels if naming.use_labels else None
    counts = {r["type"]: r["n"] for r in count_by_type(instances.select(F.explode("types").alias("type"))).collect()}
    type_names = format_names(list(counts), naming.max_table_length, pattern=naming.uri_suffix_pattern, labels=names, reserved=reserved, custom=own.format_name)
    stats = materialise(stats_of(by_type), "stats")
    used = {r[0] for r in stats.select("predicate").distinct().collect()}
    column_names = format_names(sorted(used), naming.max_column_length, pattern=naming.uri_suffix_pattern, labels=names, reserved={*reserved, "ID", "URI"}, custom=own.format_name)
    entities = collect_entity_schema(counts, stats, schema.graph, type_names, column_names, config.entities, naming.max_column_length, reserved)
    pruned = schema.graph.keep_only([t.type for t in entities.tables])

    predicates = schema.predicate_frame(spark)
    rows, relation_tables = None, []
    if config.relations.strategy != RelationStrategy.NONE:
        rows = keep_written(materialise(clustered(relation_rows(facts.relations, instances, predicates, pruned, config.relations)), "relations"), config.cache_level)
        related = [r[0] for r in rows.select("predicate_URI").distinct().collect()] if config.relations.strategy in (RelationStrategy.PREDICATES, RelationStrategy.TYPE_PREDICATES) else []
        taken = {naming.entity_prefix + t.name for t in entities.tables} if not naming.relation_prefix else set()
        relation_names = format_names(related, naming.max_table_length, pattern=naming.uri_suffix_pattern, labels=names, reserved={*reserved, *taken}, custom=own.format_name)
        relation_tables = collect_relation_schema(rows, config.relations, type_names, relation_names, taken | {EAV_TABLE})
    return Conversion(schema, instances, by_type, entities, rows, relation_tables, predicates)


def build_tables(spark: SparkSession, c: Conversion, config: ConvertConfig) -> None:
    """Fill ``tables`` (lazy, in the order to write them) and the manifest."""
    ep, rp = config.naming.entity_prefix, config.naming.relation_prefix
    if not c.entities.tables:
        return
    by_type = c.entities.by_type
    graph = c.schema.graph.keep_only(by_type)
    c.tables[M.PROPERTIES] = M.property_metadata(spark, c.entities, c.schema, ep)
    if config.relations.strategy != RelationStrategy.NONE:
        c.tables[M.RELATIONS] = M.relation_metadata(spark, c.relation_tables, c.entities, c.schema, rp, ep)
    c.tables[M.PREDICATES] = M.predicate_metadata(spark, c.schema)
    c.tables[M.ENTITIES] = M.entity_metadata(spark, c.entities, c.schema, ep)
    m = c.manifest
    m.primary_keys += [(M.PREDICATES, "predicate"), (M.ENTITIES, "entity_name")]
    m.foreign_keys += [(M.PROPERTIES, "entity_name", M.ENTITIES, "entity_name"), (M.PROPERTIES, "predicate", M.PREDICATES, "predicate")]
    if M.RELATIONS in c.tables:
        m.primary_keys.append((M.RELATIONS, "name"))
        m.foreign_keys += [(M.RELATIONS, "from_name", M.ENTITIES, "entity_name"), (M.RELATIONS, "to_name", M.ENTITIES, "entity_name"), (M.RELATIONS, "predicate", M.PREDICATES, "predicate")]
    for t in subclass_first(c.entities.tables, graph):
        c.tables[ep + t.name] = entity_frame(t, c.facts)
        m.primary_keys.append((ep + t.name, "ID"))
        m.indexes.append((ep + t.name, "URI"))
        m.foreign_keys += [(ep + t.name, "ID", ep + by_type[s].name, "ID") for s in sorted(graph.super_classes(t.type))]
    c.tables[EAV_TABLE] = attribute_frame(c.entities, c.facts, c.predicates)
    m.indexes += [(EAV_TABLE, x) for x in ("ID", "predicate", "datatype", "language")]
    m.foreign_keys.append((EAV_TABLE, "predicate", M.PREDICATES, "predicate"))
    for r in c.relation_tables:
        name = M.relation_table_name(r, rp)
        frame = relation_frame(r, c.relation_rows, config.relations, c.entities.type_names)
        c.tables[name] = frame
        m.indexes += [(name, x) for x in frame.columns]
        ends = zip(relation_columns(r, c.entities.type_names), (r.from_type, r.to_type), strict=True)
        m.foreign_keys += [(name, col, ep + by_type[t].name, "ID") for col, t in ends if t in by_type]


def convert(spark: SparkSession, source: str | DataFrame, config: ConvertConfig | None = None, sink: Persistor | None = None) -> Conversion:
    """Quads (a path or a frame) to tables in ``sink`` (the configuration's, if none is given)."""
    config = config or ConvertConfig()
    sink = sink or persistor(config.output)
    bad = None
    if isinstance(source, str):
        quads, bad = read_quads(spark, source, config.parser)
    else:
        quads = source
    c = analyse(spark, quads, config, sink.reserved_names())
    c.bad_records = bad
    build_tables(spark, c, config)
    for name, frame in c.tables.items():
        sink.write_frame(name, frame)
    sink.create_primary_keys(c.manifest.primary_keys)
    sink.create_indexes(c.manifest.indexes)
    sink.create_foreign_keys(c.manifest.foreign_keys)
    return c
