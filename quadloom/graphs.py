"""The driver's tables as quads, and the same statements in SQL for the oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from .session import ship_package
from .sources.tables import BASE, Mapping, label_quads, subclass_quads, triplify

T, R = BASE + "types#", BASE + "rel#"
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
CLASSES = [(f"{T}{s}Customer", T + "Customer") for s in SEGMENTS] + [(T + "Customer", T + "Party"), (T + "Supplier", T + "Party")]
LABELS = [(T + "Party", "a party"), (T + "Nation", "nation"), (R + "name", "the name")]


def uri(kind: str, key: str) -> str:
    return f"concat('{BASE}{kind}/', cast({key} as string))"


_DATE = """date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss")"""
MAPPINGS = {
    "region": Mapping(uri("region", "r_regionkey"), [f"'{T}Region'"], [(R + "name", "r_name", None, None)]),
    "nation": Mapping(uri("nation", "n_nationkey"), [f"'{T}Nation'"], [(R + "name", "n_name", None, None)], [(R + "inRegion", uri("region", "n_regionkey"))]),
    "customer": Mapping(uri("customer", "c_custkey"), [f"concat('{T}', c_mktsegment, 'Customer')"], [(R + "name", "c_name", None, None), (R + "acctbal", "c_acctbal", "double", None)], [(R + "inNation", uri("nation", "c_nationkey"))]),
    "supplier": Mapping(uri("supplier", "s_suppkey"), [f"'{T}Supplier'"], [(R + "name", "s_name", None, None), (R + "acctbal", "s_acctbal", "double", None)], [(R + "inNation", uri("nation", "s_nationkey"))]),
    "part": Mapping(uri("part", "p_partkey"), [f"'{T}Part'"], [(R + "name", "p_name", None, None), (R + "size", "p_size", "int", None)]),
    "orders": Mapping(uri("order", "o_orderkey"), [f"'{T}Order'"], [(R + "status", "o_orderstatus", None, None), (R + "total", "o_totalprice", "double", None), (R + "date", _DATE, "dateTime", None)], [(R + "placedBy", uri("customer", "o_custkey"))]),
    "lineitem": Mapping(uri("order", "l_orderkey"), [], [(R + "flag", "l_returnflag", None, None)], [(R + "contains", uri("part", "l_partkey"))]),
    "documents": Mapping(uri("doc", "doc_id"), [f"'{T}Document'"], [(R + "text", "text", None, "lang")]),
    "events": Mapping(uri("event", "event_id"), [f"'{T}Event'"], [(R + "value", "value", "double", None), (R + "errorCode", "case when event_type = 'error' then cast(user_id as string) end", "long", None)], [(R + "byUser", uri("user", "user_id"))]),
}
PARTY, ORDERS = ("region", "nation", "customer", "supplier"), ("orders", "lineitem", "part", "customer", "nation", "region")


def graph(spark: SparkSession, sf_dir: str, tables, schema: bool = False) -> DataFrame:
    """Quads of the tables and, if asked for, of the classes and labels."""
    ship_package(spark)
    parts = [triplify(spark.read.parquet(f"{sf_dir}/{t}.parquet"), MAPPINGS[t]) for t in tables]
    if schema:
        parts += [subclass_quads(spark, CLASSES), label_quads(spark, LABELS)]
    return reduce(DataFrame.unionByName, parts)


def graph_sql(tables, schema: bool = False) -> str:
    """A query for (s, p, o, k, dt, lang): kind k is uri or literal. Types come from rdf:type statements as well."""
    rdf_type, label, sub = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/2000/01/rdf-schema#subClassOf"
    parts = []
    for t in tables:
        m = MAPPINGS[t]
        as_sql = lambda x: x.replace(_DATE, "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')").replace(" as string)", " as varchar)")
        rows = [(rdf_type, x, "uri", None, None) for x in m.types] + [(p, v, "literal", d, lang) for p, v, d, lang in m.literals] + [(p, o, "uri", None, None) for p, o in m.links]
        for p, v, k, d, lang in rows:
            dt = f"'http://www.w3.org/2001/XMLSchema#{d}'" if d else "cast(null as varchar)"
            parts.append(f"select {as_sql(m.subject)} s, '{p}' p, cast({as_sql(v)} as varchar) o, '{k}' k, {dt} dt, {lang or 'cast(null as varchar)'} lang from {t} where ({as_sql(v)}) is not null")
    if schema:
        parts += [f"select '{a}', '{sub}', '{b}', 'uri', null, null" for a, b in CLASSES] + [f"select '{a}', '{label}', '{b}', 'literal', null, null" for a, b in LABELS]
    return "\nunion all ".join(parts)
