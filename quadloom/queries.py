"""Queries of the engine over the driver's tables, each with its oracle in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ERROR_MESSAGE, ERROR_PREDICATES, ERROR_QUAD, ERROR_SUBJECT, ERROR_TYPE, RDF_TYPE, RDFS_LABEL, RDFS_RESOURCE, RDFS_SUBCLASS, ConvertConfig, EntityConfig, InstanceConfig, InstanceFilterConfig, NamingConfig, ParserConfig, QuadFilterConfig, RdfConfig, RelationConfig, RelationStrategy
from .functions.naming import clean_name_column, clean_uri_suffix_column, unique_name_column
from .graphs import BASE, CLASSES, LABELS, ORDERS, PARTY, R, T, graph, graph_sql, uri
from .operators.entities import count_by_type, property_stats
from .operators.facts import classify, collect_facts, facts_of
from .operators.filters import by_objects, filter_instances, filter_quads, resource_frame, subjects_of_type, type_statements, without_subjects
from .operators.flavors import WIKIDATA, WikidataFlavor
from .operators.ids import dense_ids, partition_by_type, type_counts_by_hash
from .operators.rdfschema import ClassGraph, labels, predicate_index, type_index
from .operators.stats import approximate_distinct, count_by, top_uris
from .plans.convert import convert
from .session import materialise, shared_dir
from .sinks import CsvPersistor, JsonPersistor, MapPersistor
from .sinks.persistors import copy_column
from .sources.nquads import QUAD_COLUMNS, accepted_language, parse_lines, read_quads, to_lines
from .sources.tables import Mapping, triplify

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


HIERARCHY = ClassGraph([(sup, sub) for sub, sup in CLASSES])
PARTY_SQL, PARTY_SCHEMA_SQL, ORDERS_SQL = graph_sql(PARTY), graph_sql(PARTY, True), graph_sql(ORDERS)
_CLOSURE = "cl(t, a) as (values " + ", ".join(f"('{c}', '{a}')" for c in sorted({x for e in CLASSES for x in e}) for a in sorted(HIERARCHY.super_classes(c) | {c})) + ")"
#: Statements, instances with their types (supertypes added, untyped ones resources) and dense ids of the party graph.
_PARTY = f"""with q as ({PARTY_SCHEMA_SQL}), {_CLOSURE},
ty as (select distinct s uri, coalesce(a, o) type from q left join cl on t = o where p = '{RDF_TYPE}'),
u as (select distinct s uri from q union select o from q where k = 'uri' and p <> '{RDF_TYPE}'),
it as (select u.uri, coalesce(type, '{RDFS_RESOURCE}') type from u left join ty using (uri)),
ids as (select uri, row_number() over (order by uri) id from u)
"""


# --- sources


@query("parse_nquads", f"select s, p, o, k o_kind, dt o_datatype, lang o_lang from ({PARTY_SQL})")
def parse_nquads(spark, d):
    """Serialise a graph to statements and parse them again."""
    return parse_lines(to_lines(graph(spark, d, PARTY))).filter("ok").select("s", "p", "o", "o_kind", "o_datatype", "o_lang")


@query("parse_texts", f"select s, o, lang o_lang from ({graph_sql(('documents',))}) where k = 'literal' and lang in ('en', 'fr')")
def parse_texts(spark, d):
    """Whole texts through escaping and parsing, then the accepted languages."""
    found = parse_lines(to_lines(graph(spark, d, ("documents",)))).filter("ok").select(*QUAD_COLUMNS)
    return accepted_language(found, ("en", "fr")).filter("o_kind = 'literal'").select("s", "o", "o_lang")


@query("parse_bad_lines", "select line, count(*) n from (select unnest(string_split(text, chr(10))) line from documents) where trim(line, ' ' || chr(9) || chr(13)) <> '' and not starts_with(ltrim(line), '#') group by line")
def parse_bad_lines(spark, d):
    """Lines of prose are no statements: all of them are kept aside."""
    lines = spark.read.parquet(f"{d}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("value"))
    return parse_lines(lines).filter("not ok").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


_PARSED = f"select s, p, o, k o_kind, dt o_datatype, lang o_lang from ({PARTY_SQL})"
_SIX = ["s", "p", "o", "o_kind", "o_datatype", "o_lang"]


def _folder(spark, name) -> str:
    return f"{shared_dir(spark)}/quadloom/{name}-{uuid.uuid4().hex}"


@query("parse_nquads_gzip", _PARSED)
def parse_nquads_gzip(spark, d):
    """Statements in gzipped files of a folder."""
    path = _folder(spark, "statements")
    to_lines(graph(spark, d, PARTY)).write.option("compression", "gzip").text(path)
    return read_quads(spark, path, ParserConfig(line_based=True))[0].select(*_SIX)


def _documents(spark, d, name: str, head: str, row, between: str, tail: str) -> str:
    """A folder of whole documents, one for each subject's first letters: so there are several, and none is a line."""
    quads = graph(spark, d, PARTY).withColumn("part", F.pmod(F.xxhash64("s"), F.lit(5)))
    text = quads.groupBy("part").agg(F.concat(F.lit(head), F.array_join(F.collect_list(row), between), F.lit(tail)).alias("value"))
    path = _folder(spark, name)
    text.write.partitionBy("part").text(path)  # a row, and so a document, for each folder
    return path


def _escaped(c: str):
    x = F.col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


@query("parse_rdfxml", _PARSED)
def parse_rdfxml(spark, d):
    """The graph as RDF/XML documents."""
    space = F.regexp_extract("p", "^(.*[#/])[^#/]+$", 1)
    name = F.regexp_extract("p", "([^#/]+)$", 1)
    inner = F.when(F.col("o_kind") == "uri", F.concat(F.lit(' rdf:resource="'), _escaped("o"), F.lit('"/>'))).otherwise(
        F.concat(F.when(F.col("o_datatype").isNotNull(), F.concat(F.lit(' rdf:datatype="'), F.col("o_datatype"), F.lit('"'))).otherwise(""), F.lit(">"), _escaped("o"), F.lit("</x:"), name, F.lit(">"))
    )
    row = F.concat(F.lit('<rdf:Description rdf:about="'), _escaped("s"), F.lit('"><x:'), name, F.lit(' xmlns:x="'), space, F.lit('"'), inner, F.lit("</rdf:Description>"))
    path = _documents(spark, d, "rdfxml", f'<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="{RDF_TYPE.removesuffix("type")}">\n', row, "\n", "\n</rdf:RDF>")
    return read_quads(spark, path, ParserConfig(syntax="rdfxml"))[0].select(*_SIX)


@query("parse_jsonld", _PARSED)
def parse_jsonld(spark, d):
    """The graph as JSON-LD documents."""
    value = F.when(F.col("o_kind") == "uri", F.to_json(F.struct(F.col("o").alias("@id")))).otherwise(F.to_json(F.struct(F.col("o").alias("@value"), F.col("o_datatype").alias("@type"))))
    of = F.when(F.col("p") == RDF_TYPE, F.concat(F.lit('"@type":"'), F.col("o"), F.lit('"'))).otherwise(F.concat(F.lit('"r:'), F.substring_index("p", "#", -1), F.lit('":'), value))
    row = F.concat(F.lit('{"@id":"'), F.col("s"), F.lit('",'), of, F.lit("}"))
    path = _documents(spark, d, "jsonld", f'{{"@context": {{"r": "{R}"}},\n"@graph": [', row, ",\n", "]}")
    return read_quads(spark, path, ParserConfig(syntax="jsonld"))[0].select(*_SIX)


@query("parse_turtle", _PARSED)
def parse_turtle(spark, d):
    """The graph as Turtle documents with a prefix."""
    obj = F.when(F.col("o_kind") == "uri", F.concat(F.lit("<"), F.col("o"), F.lit(">"))).otherwise(F.concat(F.lit('"'), F.col("o"), F.lit('"'), F.when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">"))).otherwise("")))
    verb = F.when(F.col("p") == RDF_TYPE, F.lit("a")).otherwise(F.concat(F.lit("r:"), F.substring_index("p", "#", -1)))
    path = _documents(spark, d, "turtle", f"@prefix r: <{R}> .\n", F.concat_ws(" ", F.concat(F.lit("<"), F.col("s"), F.lit(">")), verb, obj, F.lit(".")), "\n", "\n")
    return read_quads(spark, path)[0].select(*_SIX)


# --- statistics


for _stat, _c, _where in (("subject", "s", "true"), ("predicate", "p", "true"), ("object", "o", "k = 'uri'")):
    query(f"stats_{_stat}", f"select {_c} uri, count(*) count from ({ORDERS_SQL}) where {_where} group by 1 order by 2 desc, 1 limit 100")(
        lambda spark, d, stat=_stat: top_uris(count_by(graph(spark, d, ORDERS), f"{stat.upper()}_URI_COUNT"))
    )


@query("stats_totals", f"select 'SUBJECT_URI_COUNT' stat, count(distinct s) n_uris from ({ORDERS_SQL}) union all select 'PREDICATE_URI_COUNT', count(distinct p) from ({ORDERS_SQL}) union all select 'OBJECT_URI_COUNT', count(distinct o) from ({ORDERS_SQL}) where k = 'uri'")
def stats_totals(spark, d):
    q = graph(spark, d, ORDERS)
    parts = [count_by(q, s).agg(F.count(F.lit(1)).alias("n_uris")).select(F.lit(s).alias("stat"), "n_uris") for s in ("SUBJECT_URI_COUNT", "PREDICATE_URI_COUNT", "OBJECT_URI_COUNT")]
    return parts[0].union(parts[1]).union(parts[2])


@query("stats_approximate")
def stats_approximate(spark, d):
    return approximate_distinct(graph(spark, d, ORDERS), "SUBJECT_URI_COUNT")


# --- RDF schema


@query("type_index", f"select distinct o type_URI from ({PARTY_SCHEMA_SQL}) where k = 'uri' and p in ('{RDF_TYPE}', '{RDFS_SUBCLASS}') union select unnest(['{ERROR_TYPE}', '{RDFS_RESOURCE}'])")
def q_type_index(spark, d):
    return type_index(graph(spark, d, PARTY, True), RdfConfig())


@query("predicate_index", f"select cast(row_number() over (order by predicate_URI) - 1 as integer) predicate, predicate_URI from (select distinct p predicate_URI from ({PARTY_SCHEMA_SQL}) union select unnest({list(ERROR_PREDICATES)}))")
def q_predicate_index(spark, d):
    return predicate_index(graph(spark, d, PARTY, True))


@query("labels", "select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in LABELS) + ") x(uri, label)")
def q_labels(spark, d):
    q = graph(spark, d, PARTY, True)
    uris = type_index(q, RdfConfig()).select(F.col("type_URI").alias("uri")).union(predicate_index(q).select("predicate_URI"))
    return labels(q, uris)


@query("class_closure", f"""with recursive e(sub, sup) as (select s, o from ({PARTY_SCHEMA_SQL}) where p = '{RDFS_SUBCLASS}'),
c(type, ancestor) as (select sub, sup from e union select c.type, e.sup from c join e on e.sub = c.ancestor) select distinct type, ancestor from c""")
def class_closure(spark, d):
    from .operators.rdfschema import collect_schema

    return collect_schema(graph(spark, d, PARTY, True), RdfConfig()).graph.closure(spark).filter("type <> ancestor")


# --- facts, instances, ids


def _facts(spark, d, tables=PARTY, schema=True):
    """Facts of a graph whose statements are classified once."""
    return facts_of(materialise(classify(graph(spark, d, tables, schema), (RDF_TYPE,)), "statements"), HIERARCHY)


@query("instances", _PARTY + "select id, uri, string_agg(type, ',' order by type) types from it join ids using (uri) group by 1, 2")
def instances(spark, d):
    return dense_ids(_facts(spark, d).instances).select("id", "uri", F.array_join("types", ",").alias("types"))


@query("default_type", f"select distinct concat('{BASE}user/', cast(user_id as varchar)) uri from events")
def default_type(spark, d):
    """Users are only mentioned: they become resources."""
    found = collect_facts(graph(spark, d, ("events",)), (RDF_TYPE,)).instances
    return found.filter(F.array_contains("types", RDFS_RESOURCE)).select("uri")


@query("literals", f"select s uri, p predicate, case when dt is null then 'STRING' else 'DOUBLE' end ltype, cast(o as varchar) value from ({PARTY_SQL}) where k = 'literal'")
def literals(spark, d):
    return collect_facts(graph(spark, d, PARTY), (RDF_TYPE,)).literals.select("uri", "predicate", "ltype", F.explode("values").alias("value"))


@query("relation_facts", f"select distinct s uri, p predicate, o object from ({ORDERS_SQL}) where k = 'uri' and p <> '{RDF_TYPE}'")
def relation_facts(spark, d):
    return collect_facts(graph(spark, d, ORDERS), (RDF_TYPE,)).relations


@query("multivalued", f"select s uri, string_agg(distinct o, ',' order by o) flags from ({graph_sql(('lineitem',))}) where k = 'literal' group by 1 having count(distinct o) > 1")
def multivalued(spark, d):
    return collect_facts(graph(spark, d, ("lineitem",)), (RDF_TYPE,)).literals.filter("size(values) > 1").select("uri", F.array_join("values", ",").alias("flags"))


_BAD = "concat('<{0}event/', cast(event_id as varchar), '> <{1}flag> \"', event_type, '\"^^<http://www.w3.org/2001/XMLSchema#boolean> <{0}g> .')".format(BASE, R)


@query(
    "errors",
    f"""with e as (select concat('{BASE}event/', cast(event_id as varchar)) s, {_BAD} q from events)
select q, '{ERROR_SUBJECT}' predicate, s as value from e union all select q, '{ERROR_QUAD}', q from e union all select q, '{ERROR_MESSAGE}', 'not a value of http://www.w3.org/2001/XMLSchema#boolean' from e""",
)
def errors(spark, d):
    """Event types aren't booleans: every statement becomes an instance that says so."""
    from .operators.facts import classify, error_literals
    from .sources.tables import Mapping, triplify

    q = triplify(spark.read.parquet(f"{d}/events.parquet"), Mapping(f"concat('{BASE}event/', cast(event_id as string))", [], [(R + "flag", "event_type", "boolean", None)]))
    found = error_literals(classify(q, (RDF_TYPE,)))
    return found.select(F.url_decode(F.substring_index("uri", ":error:", -1)).alias("q"), "predicate", "value")


@query("type_counts", _PARTY + "select type, count(*) n from it group by 1")
def type_counts(spark, d):
    return count_by_type(_facts(spark, d).types)


@query("property_stats", _PARTY + f"select type, p predicate, case when dt is null then 'STRING' else 'DOUBLE' end ltype, count(*) n, false multivalued from it join q on s = uri where k = 'literal' group by 1, 2, 3")
def q_property_stats(spark, d):
    f = _facts(spark, d)
    return property_stats(f.types, f.literals).drop("lang")


_TYPED = {  # datatype: value in Spark, the same in DuckDB, type (null: rejected), canonical value in DuckDB
    "long": ("cast((l_orderkey + 1) * 10000000000 as string)", "cast((l_orderkey + 1) * 10000000000 as varchar)", "'LONG'", "cast((l_orderkey + 1) * 10000000000 as varchar)"),
    "boolean": ("case when l_linenumber = 1 then '1' when l_linenumber = 2 then 'false' when l_linenumber = 3 then 'true' else 'yes' end", "case when l_linenumber = 1 then '1' when l_linenumber = 2 then 'false' when l_linenumber = 3 then 'true' else 'yes' end", "case when l_linenumber < 4 then 'BOOLEAN' end", "case l_linenumber when 2 then 'false' else 'true' end"),
    "dateTime": ("concat('2001-02-0', cast(l_linenumber as string), case when l_linenumber > 2 then 'T10:00:00Z' else '' end)", "'2001-02-0' || cast(l_linenumber as varchar) || case when l_linenumber > 2 then 'T10:00:00Z' else '' end", "case when l_linenumber > 2 then 'DATETIME' end", "'2001-02-0' || cast(l_linenumber as varchar) || 'T10:00:00Z'"),
    "float": ("concat(cast(l_linenumber as string), '.5')", "cast(l_linenumber as varchar) || '.5'", "'FLOAT'", "cast(l_linenumber as varchar) || '.5'"),
    "byte": ("cast(l_linenumber * 40 as string)", "cast(l_linenumber * 40 as varchar)", "case when l_linenumber < 4 then 'INTEGER' end", "cast(l_linenumber * 40 as varchar)"),
    "decimal": ("concat(cast(l_linenumber as string), '.50')", "cast(l_linenumber as varchar) || '.50'", "'STRING'", "cast(l_linenumber as varchar) || '.50'"),
}
_TYPED_SQL = " union all ".join(f"select '{d}' datatype, {raw} raw, {t} ltype, case when {t} is null then null else {v} end as value from lineitem" for d, (_, raw, t, v) in _TYPED.items())


@query("literal_types", f"select datatype, coalesce(ltype, 'rejected') ltype, coalesce(value, raw) as value, count(*) n from ({_TYPED_SQL}) group by all")
def literal_types(spark, d):
    """Values of every other type, and those that their datatype doesn't allow."""
    q = triplify(spark.read.parquet(f"{d}/lineitem.parquet"), Mapping("'urn:x'", [], [(R + t, v, t, None) for t, (v, *_) in _TYPED.items()]))
    found = classify(q, (RDF_TYPE,)).select(F.substring_index("o_datatype", "#", -1).alias("datatype"), F.when(F.col("kind") == "error", "rejected").otherwise(F.col("ltype")).alias("ltype"), F.coalesce("value", "o").alias("value"))
    return found.groupBy("datatype", "ltype", "value").agg(F.count(F.lit(1)).alias("n"))


@query("default_language", f"select concat('{BASE}doc/', cast(doc_id as varchar)) uri, coalesce(nullif(lang, 'en'), 'none') lang from documents where text is not null")
def default_language(spark, d):
    """Tags of the default language go."""
    found = collect_facts(graph(spark, d, ("documents",)), (RDF_TYPE,), None, InstanceConfig(default_language="en")).literals
    return found.select("uri", F.coalesce("lang", F.lit("none")).alias("lang"))


@query("nul_removed", "select concat('urn:', cast(c_custkey as varchar)) uri, c_name || c_mktsegment as value from customer")
def nul_removed(spark, d):
    q = triplify(spark.read.parquet(f"{d}/customer.parquet"), Mapping("concat('urn:', cast(c_custkey as string))", [], [(R + "v", "concat(c_name, char(0), c_mktsegment, char(0))", None, None)]))
    return collect_facts(q, (RDF_TYPE,)).literals.select("uri", F.col("values")[0].alias("value"))


@query("type_partitions", _PARTY + "select types, count(*) n from (select uri, string_agg(type, ',' order by type) types from it group by 1) group by 1")
def type_partitions(spark, d):
    """Laid out by type, no instance is lost or doubled."""
    found = partition_by_type(materialise(dense_ids(_facts(spark, d).instances), "instances"), 4, 100)
    return found.groupBy(F.array_join("types", ",").alias("types")).agg(F.count(F.lit(1)).alias("n"))


@query("type_hash_counts", _PARTY + "select count(*) n from (select uri, string_agg(type, ',' order by type) types from it group by 1) group by types")
def type_hash_counts(spark, d):
    return type_counts_by_hash(_facts(spark, d).instances).select("n")


# --- entity, attribute and metadata tables


def _converted(spark, d, name, tables=PARTY, schema=True, **groups) -> DataFrame:
    sink = MapPersistor()
    convert(spark, graph(spark, d, tables, schema), ConvertConfig(**groups), sink)
    return sink.result[name]


_ENTITY = _PARTY + "select id as ID, uri as URI{columns} from it join ids using (uri){join} where type = '{type}'"
_VALUES = f" join (select s uri, max(case when p = '{R}acctbal' then cast(o as double) end) acctbal, max(case when p = '{R}name' then o end) name from q group by 1) v using (uri)"


@query("entity_party", _ENTITY.format(columns=", acctbal, name", join=_VALUES, type=T + "Party"))
def entity_party(spark, d):
    return _converted(spark, d, "party")


@query("entity_customer", _ENTITY.format(columns="", join="", type=T + "Customer"))
def entity_customer(spark, d):
    """All columns are stored by the superclass's table."""
    return _converted(spark, d, "customer")


@query("entity_customer_redundant", _ENTITY.format(columns=", acctbal, name", join=_VALUES, type=T + "Customer"))
def entity_customer_redundant(spark, d):
    return _converted(spark, d, "customer", entities=EntityConfig(redundant_subclass_columns=True))


@query("entity_nation", _ENTITY.format(columns=", name", join=_VALUES, type=T + "Nation"))
def entity_nation(spark, d):
    return _converted(spark, d, "nation")


@query(
    "entity_order",
    f"""with q as ({graph_sql(('orders', 'lineitem'))}), u as (select distinct s uri from q union select o from q where k = 'uri' and p <> '{RDF_TYPE}'), ids as (select uri, row_number() over (order by uri) id from u)
select id as ID, uri as URI, max(case when p = '{R}date' then o end) date, max(case when p = '{R}status' then o end) status, max(case when p = '{R}total' then cast(o as double) end) total, min(case when p = '{R}flag' then o end) flag
from q join ids on uri = s where exists (select 1 from orders where concat('{BASE}order/', cast(o_orderkey as varchar)) = uri) group by 1, 2""",
)
def entity_order(spark, d):
    """Several return flags per order: the least is shown, all are attributes."""
    return _converted(spark, d, "order", ("orders", "lineitem"), False)


@query(
    "entity_order_limited",
    f"""with q as ({graph_sql(('orders', 'lineitem'))}), u as (select distinct s uri from q union select o from q where k = 'uri' and p <> '{RDF_TYPE}'), ids as (select uri, row_number() over (order by uri) id from u)
select id as ID, uri as URI, max(case when p = '{R}date' then o end) date, max(case when p = '{R}status' then o end) status from q join ids on uri = s where exists (select 1 from orders where concat('{BASE}order/', cast(o_orderkey as varchar)) = uri) group by 1, 2""",
)
def entity_order_limited(spark, d):
    """The two most frequent properties are columns; ties by predicate. The flag is rarer, as some orders have no items here."""
    q = graph(spark, d, ("orders",)).unionByName(graph(spark, d, ("lineitem",)).filter(F.substring_index("s", "/", -1).cast("long") % 7 != 0))
    sink = MapPersistor()
    convert(spark, q, ConvertConfig(entities=EntityConfig(max_columns=2)), sink)
    return sink.result["order"].drop("ID").join(dense_ids(_facts(spark, d, ("orders", "lineitem"), False).instances).select(F.col("id").alias("ID"), F.col("uri").alias("URI")), "URI").select("ID", "URI", "date", "status")


_BIO = "http://bio2rdf.org/"


@query("bio2rdf_names", "select lower(c_mktsegment) || '_resource' entity_name, count(*) num_rows from customer group by 1")
def bio2rdf_names(spark, d):
    """Names take the data set from the vocabulary's address."""
    q = triplify(spark.read.parquet(f"{d}/customer.parquet"), Mapping(f"concat('{_BIO}c:', cast(c_custkey as string))", [f"concat('{_BIO}', lower(c_mktsegment), '_vocabulary:Resource')"], [(R + "name", "c_name", None, None)]))
    sink = MapPersistor()
    convert(spark, q, ConvertConfig(flavor="Bio2RDF"), sink)
    return sink.result["_META_Entities"].select("entity_name", "num_rows")


@query("table_names", "select unnest(['nation', 'nation_2', 'customer', 'name_of']) table_name")
def table_names(spark, d):
    """A relation named like an entity table gets a number."""
    q = triplify(spark.read.parquet(f"{d}/customer.parquet"), Mapping(uri("customer", "c_custkey"), [f"'{T}Customer'"], [], [(R + "nation", uri("nation", "c_nationkey")), (R + "name_of", uri("nation", "c_nationkey"))]))
    q = q.unionByName(triplify(spark.read.parquet(f"{d}/nation.parquet"), Mapping(uri("nation", "n_nationkey"), [f"'{T}Nation'"], [(R + "title", "n_name", None, None)])))
    sink = MapPersistor()
    convert(spark, q, ConvertConfig(relations=RelationConfig(strategy=RelationStrategy.PREDICATES)), sink)
    return spark.createDataFrame([(n,) for n in sink.result if not n.startswith("_")], "table_name string")


_EAV = """with q as ({graph}), u as (select distinct s uri from q union select o from q where k = 'uri' and p <> '{t}'), ids as (select uri, row_number() over (order by uri) id from u),
pr as (select predicate_URI, cast(row_number() over (order by predicate_URI) - 1 as integer) predicate from (select distinct p predicate_URI from q union select unnest({e})))
select distinct id as ID, predicate, {datatype} datatype, cast(null as varchar) as language, o as value from q join ids on uri = s join pr on p = predicate_URI where {where}"""


@query("attributes", _EAV.format(graph=graph_sql(("orders", "lineitem")), t=RDF_TYPE, e=list(ERROR_PREDICATES), datatype="'STRING'", where=f"p = '{R}flag'"))
def attributes(spark, d):
    return _converted(spark, d, "_attributes", ("orders", "lineitem"), False)


@query("attributes_redundant", _EAV.format(graph=PARTY_SQL, t=RDF_TYPE, e=list(ERROR_PREDICATES), datatype="case when dt is null then 'STRING' else 'DOUBLE' end", where="k = 'literal'"))
def attributes_redundant(spark, d):
    return _converted(spark, d, "_attributes", PARTY, False, entities=EntityConfig(redundant_eav=True))


@query("attributes_sparse", _EAV.format(graph=graph_sql(("events",)), t=RDF_TYPE, e=list(ERROR_PREDICATES), datatype="'INTEGER'", where=f"p = '{R}errorCode'"))
def attributes_sparse(spark, d):
    """A property of few events is an attribute, not a column."""
    return _converted(spark, d, "_attributes", ("events",), False, entities=EntityConfig(min_non_null_fraction=0.9))


_NAMES = {T + "Region": "region", T + "Nation": "nation", T + "Customer": "customer", T + "Supplier": "supplier", T + "Party": "party", RDFS_RESOURCE: "resource", **{f"{T}{s}Customer": f"{s.lower()}customer" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")}}
_NAMED = "n(type, name) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in _NAMES.items()) + ")"


@query("meta_entities", _PARTY + f", {_NAMED}, l as (select s type, o label from q where p = '{RDFS_LABEL}') select name entity_name, type entity_URI, label entity_label, count(*) num_rows from it join n using (type) left join l using (type) group by 1, 2, 3")
def meta_entities(spark, d):
    return _converted(spark, d, "_META_Entities")


@query("meta_predicates", f"with q as ({PARTY_SCHEMA_SQL}) select cast(row_number() over (order by x) - 1 as integer) predicate, x predicate_URI, o predicate_label from (select distinct p x from q union select unnest({list(ERROR_PREDICATES)})) left join q on s = x and p = '{RDFS_LABEL}'")
def meta_predicates(spark, d):
    return _converted(spark, d, "_META_Predicates")


@query(
    "meta_properties",
    _PARTY + f""", {_NAMED}, pr as (select predicate_URI, cast(row_number() over (order by predicate_URI) - 1 as integer) predicate from (select distinct p predicate_URI from q union select unnest({list(ERROR_PREDICATES)}))),
c as (select type, count(*) n from it group by 1), f as (select type, p, dt, count(*) m from it join q on s = uri where k = 'literal' group by 1, 2, 3)
select name entity_name, predicate, regexp_extract(lower(p), '[^#]+$') column_name, true is_column, true is_attribute, false is_multivalued, case when dt is null then 'STRING' else 'DOUBLE' end as datatype, cast(null as varchar) as language, m / n non_null,
case when type in (select t from cl where a = '{T}Party' and t <> a) then 'party.' || regexp_extract(lower(p), '[^#]+$') end in_superclass from f join c using (type) join n using (type) join pr on p = predicate_URI""",
)
def meta_properties(spark, d):
    return _converted(spark, d, "_META_Properties")


_PAIRS = """, rel as (select distinct s, p, o from q where k = 'uri' and p <> '{t}'), roots as (select uri, type, count(*) over (partition by uri) c from it),
rt as (select uri, type from roots where c = 1 or type not in (select t from cl where t <> a))"""
_PAIRS = _PAIRS.format(t=RDF_TYPE)


@query("meta_relations", _PARTY + _PAIRS + f", {_NAMED} select distinct x.name || '_' || y.name as name, x.name from_name, y.name to_name from rel join rt f on f.uri = s join rt g on g.uri = o join n x on x.type = f.type join n y on y.type = g.type")
def meta_relations(spark, d):
    return _converted(spark, d, "_META_Relations").drop("predicate")  # null in this layout


@query("meta_relations_typed", _PARTY + _PAIRS + f""", {_NAMED}, pr as (select predicate_URI, cast(row_number() over (order by predicate_URI) - 1 as integer) predicate from (select distinct p predicate_URI from q union select unnest({list(ERROR_PREDICATES)})))
select distinct x.name || '_' || lower(regexp_extract(p, '[^#]+$')) || '_' || y.name as name, x.name from_name, y.name to_name, predicate from rel join rt f on f.uri = s join rt g on g.uri = o join n x on x.type = f.type join n y on y.type = g.type join pr on p = predicate_URI""")
def meta_relations_typed(spark, d):
    """The layout in which every column of the relation metadata is filled."""
    return _converted(spark, d, "_META_Relations", relations=RelationConfig(strategy=RelationStrategy.TYPE_PREDICATES))


@query("entity_keys", _PARTY + f""", {_NAMED}, t as (select distinct name, type from it join n using (type)), own as (select t, a from cl where t <> a)
select 'primary' kind, 'e_' || name table_name, 'ID' column_name, '' referred from t union all select 'index', 'e_' || name, 'URI', '' from t
union all select 'foreign', 'e_' || t.name, 'ID', 'e_' || b.name from t join own on own.t = t.type join t b on b.type = own.a""")
def entity_keys(spark, d):
    """Keys and indexes of the entity tables, with a prefix."""
    c = convert(spark, graph(spark, d, PARTY, True), ConvertConfig(naming=NamingConfig(entity_prefix="e_")), MapPersistor())
    m = c.manifest
    rows = [("primary", t, x, "") for t, x in m.primary_keys] + [("index", t, x, "") for t, x in m.indexes] + [("foreign", t, x, u) for t, x, u, _ in m.foreign_keys]
    return spark.createDataFrame([r for r in rows if r[1].startswith("e_")], "kind string, table_name string, column_name string, referred string")


# --- relation tables


def _relations(spark, d, **options) -> DataFrame:
    """All relation tables of a layout in one frame: table, a, b, predicate_URI."""
    sink = MapPersistor()
    c = convert(spark, graph(spark, d, PARTY, True), ConvertConfig(relations=RelationConfig(**options)), sink)
    out = None
    for t in c.relation_tables:
        frame = sink.result[t.name]
        frame = frame.toDF("a", "b", *frame.columns[2:]).select(F.lit(t.name).alias("table_name"), "a", "b")
        out = frame if out is None else out.union(frame)
    return out


_PRED = "lower(regexp_extract(p, '[^#]+$'))"
_JOIN = " from rel join rt f on f.uri = s join rt g on g.uri = o join ids fi on fi.uri = s join ids gi on gi.uri = o join n x on x.type = f.type join n y on y.type = g.type"


@query("relations_types", _PARTY + _PAIRS + f", {_NAMED} select x.name || '_' || y.name table_name, fi.id a, gi.id b" + _JOIN)
def relations_types(spark, d):
    return _relations(spark, d)


@query("relations_all_types", _PARTY + _PAIRS + f", {_NAMED} select x.name || '_' || y.name table_name, fi.id a, gi.id b" + _JOIN.replace("rt f", "it f").replace("rt g", "it g"))
def relations_all_types(spark, d):
    return _relations(spark, d, root_types_only=False)


@query("relations_type_predicates", _PARTY + _PAIRS + f", {_NAMED} select x.name || '_' || {_PRED} || '_' || y.name table_name, fi.id a, gi.id b" + _JOIN)
def relations_type_predicates(spark, d):
    return _relations(spark, d, strategy=RelationStrategy.TYPE_PREDICATES)


@query("relations_predicates", _PARTY + f", rel as (select distinct s, p, o from q where k = 'uri' and p <> '{RDF_TYPE}') select {_PRED} table_name, fi.id a, gi.id b from rel join ids fi on fi.uri = s join ids gi on gi.uri = o")
def relations_predicates(spark, d):
    return _relations(spark, d, strategy=RelationStrategy.PREDICATES)


@query("relations_single", _PARTY + f", rel as (select distinct s, p, o from q where k = 'uri' and p <> '{RDF_TYPE}'), pr as (select x, cast(row_number() over (order by x) - 1 as integer) predicate from (select distinct p x from q union select unnest({list(ERROR_PREDICATES)}))) select fi.id as ID_from, gi.id as ID_to, predicate from rel join ids fi on fi.uri = s join ids gi on gi.uri = o join pr on x = p")
def relations_single(spark, d):
    return _converted(spark, d, "_relations", relations=RelationConfig(strategy=RelationStrategy.SINGLE_TABLE))


@query("relations_orders", f"select distinct o_orderkey order_key, l_partkey part_key from orders join lineitem on l_orderkey = o_orderkey where l_partkey in (select p_partkey from part)")
def relations_orders(spark, d):
    """A large relation, resolved through two joins on URIs."""
    sink = MapPersistor()
    convert(spark, graph(spark, d, ("orders", "lineitem", "part")), ConvertConfig(), sink)
    t = sink.result
    key = lambda n: F.substring_index(F.col(n), "/", -1).cast("long")
    found = t["order_part"].select(F.col("order_ID").alias("i"), F.col("part_ID").alias("j"))
    return found.join(t["order"].select(F.col("ID").alias("i"), key("URI").alias("order_key")), "i").join(t["part"].select(F.col("ID").alias("j"), key("URI").alias("part_key")), "j").select("order_key", "part_key")


# --- filters

_SEEDS = [f"{BASE}customer/1", f"{BASE}supplier/1"]


def _hops_sql(depth: int, directed: bool, seeds, black=()) -> str:
    steps = [f"h0 as (select unnest({seeds}) uri)"]
    for i in range(depth):
        both = "" if directed else f" union select s from q where o in (select uri from h{i}) and k = 'uri'"
        steps.append(f"h{i + 1} as (select uri from h{i} union select o from q where s in (select uri from h{i}) and k = 'uri'{both})")
    gone = f" and s not in (select unnest({list(black)}))" if black else ""
    return f"with q as ({PARTY_SQL}), {', '.join(steps)} select s, p, o from q where s in (select uri from h{depth}){gone}"


for _depth in range(4):
    query(f"filter_resource_depth{_depth}", _hops_sql(_depth, True, _SEEDS))(lambda spark, d, n=_depth: filter_quads(graph(spark, d, PARTY), QuadFilterConfig(tuple(_SEEDS), (), n)).select("s", "p", "o"))
for _depth in (1, 2):
    query(f"filter_undirected_depth{_depth}", _hops_sql(_depth, False, [f"{BASE}region/1"]))(lambda spark, d, n=_depth: filter_quads(graph(spark, d, PARTY), QuadFilterConfig((f"{BASE}region/1",), (), n, False)).select("s", "p", "o"))


@query("filter_resource_blacklist", _hops_sql(2, True, _SEEDS, [f"{BASE}customer/1"]))
def filter_resource_blacklist(spark, d):
    return filter_quads(graph(spark, d, PARTY), QuadFilterConfig(tuple(_SEEDS), (f"{BASE}customer/1",), 2)).select("s", "p", "o")


@query("blacklist", f"select s, p, o from ({PARTY_SQL}) where s not in ('{BASE}customer/1', '{BASE}nation/3')")
def blacklist(spark, d):
    return without_subjects(graph(spark, d, PARTY), resource_frame(spark, [f"{BASE}customer/1", f"{BASE}nation/3"])).select("s", "p", "o")


@query("filter_objects", f"select s, p, o from ({PARTY_SQL}) where k = 'uri' and o = '{BASE}nation/3'")
def filter_objects(spark, d):
    return by_objects(graph(spark, d, PARTY), resource_frame(spark, [f"{BASE}nation/3"])).select("s", "p", "o")


@query("type_statements", f"select s, o from ({PARTY_SQL}) where p = '{RDF_TYPE}'")
def q_type_statements(spark, d):
    return type_statements(graph(spark, d, PARTY), (RDF_TYPE,)).select("s", "o")


@query("subjects_of_type", f"select concat('{BASE}supplier/', cast(s_suppkey as varchar)) uri from supplier union select concat('{BASE}nation/', cast(n_nationkey as varchar)) from nation")
def q_subjects_of_type(spark, d):
    return subjects_of_type(graph(spark, d, PARTY), resource_frame(spark, [T + "Supplier", T + "Nation"]), (RDF_TYPE,))


_ACCEPT = (T + "Customer", T + "Nation")


@query("filter_type", _PARTY + f"select uri, string_agg(type, ',' order by type) types from it where type in {_ACCEPT} group by 1")
def filter_type(spark, d):
    return filter_instances(_facts(spark, d).instances, InstanceFilterConfig(_ACCEPT)).select("uri", F.array_join("types", ",").alias("types"))


@query("filter_type_keep_others", _PARTY + f"select uri, string_agg(type, ',' order by type) types from it group by 1 having bool_or(type in {_ACCEPT})")
def filter_type_keep_others(spark, d):
    return filter_instances(_facts(spark, d).instances, InstanceFilterConfig(_ACCEPT, False)).select("uri", F.array_join("types", ",").alias("types"))


# --- names, flavors, sinks

_CLEAN = "regexp_replace(regexp_replace(lower(regexp_replace({0}, '[^A-Za-z0-9_]+', '_', 'g')), '^_+', ''), '_+$', '')"


@query("clean_names", f"select p_name, substring(case when regexp_matches(x, '^[0-9]') then 'N' || x else x end, 1, 12) name from (select distinct p_name, {_CLEAN.format('p_name')} x from part)")
def clean_names(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_name").distinct().select("p_name", clean_name_column(F.col("p_name"), 12).alias("name"))


@query("unique_names", f"select uri, case when i = 1 then name else substring(name, 1, 8 - length('_' || cast(i as varchar))) || '_' || cast(i as varchar) end name from (select uri, name, row_number() over (partition by name order by uri) i from (select distinct concat('{BASE}x/', cast(c_custkey as varchar), '#', c_mktsegment) uri, substring(lower(c_mktsegment), 1, 8) name from customer))")
def unique_names(spark, d):
    u = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit(f"{BASE}x/"), F.col("c_custkey").cast("string"), F.lit("#"), F.col("c_mktsegment")).alias("uri"))
    named = u.select("uri", clean_uri_suffix_column(F.col("uri"), "[/:#=]", 8).alias("name"))
    return named.select("uri", unique_name_column(F.col("uri"), F.col("name"), 8).alias("name"))


@query(
    "wikidata_labels",
    f"""with q as (select concat('{WIKIDATA}entity/P', cast(p_partkey as varchar)) s, p_name o from part), c as (select unnest(['{WIKIDATA}entity/P', '{WIKIDATA}prop/direct/P', '{WIKIDATA}prop/statement/P', '{WIKIDATA}prop/qualifier/P']) x)
select replace(s, '{WIKIDATA}entity/P', x) s, o from q, c""",
)
def wikidata_labels(spark, d):
    from .sources.tables import Mapping, triplify

    q = triplify(spark.read.parquet(f"{d}/part.parquet"), Mapping(f"concat('{WIKIDATA}entity/P', cast(p_partkey as string))", [], [(RDFS_LABEL, "p_name", None, None)]))
    return WikidataFlavor().modify_quads(q).select("s", "o")


@query("copy_rows", """select doc_id, '"' || cast(doc_id as varchar) || '"|"' || replace(text, '"', '""') || '"|"' || lang || '"' line from documents""")
def copy_rows(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")
    return docs.select("doc_id", copy_column(docs).alias("line"))


@query("csv_round_trip", "select doc_id, text, lang from documents")
def csv_round_trip(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")
    sink = CsvPersistor(f"{shared_dir(spark)}/quadloom/csv-{uuid.uuid4().hex}")
    sink.write_frame("documents", docs)
    return sink.read_frame(spark, "documents", docs.schema)


@query("json_round_trip", "select doc_id, text, lang from documents")
def json_round_trip(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")
    sink = JsonPersistor(f"{shared_dir(spark)}/quadloom/json-{uuid.uuid4().hex}")
    sink.write_frame("documents", docs)
    return spark.read.schema(docs.schema).json(f"{sink.folder}/documents")
