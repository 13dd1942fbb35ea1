"""Quads to facts: who has which types, which literals and which relations.

A frame is classified (once, if it is written before ``facts_of``); three aggregates come from it: ``types`` (uri, type), ``literals`` (uri, predicate,
ltype, lang, values) and ``relations`` (uri, predicate, object). Values are sorted arrays of distinct canonical texts.
What can't be converted becomes an instance of the error type that says why; the rest of its subject stays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ERROR_MESSAGE, ERROR_QUAD, ERROR_SUBJECT, ERROR_TYPE, ERROR_URI, RDFS_RESOURCE, InstanceConfig
from ..functions.xsd import literal_type, literal_value
from ..sources.nquads import statement_text
from .rdfschema import ClassGraph


@dataclass
class Facts:
    types: DataFrame
    literals: DataFrame
    relations: DataFrame
    instances: DataFrame  # uri, types (sorted array, never empty)


def classify(quads: DataFrame, type_predicates: tuple[str, ...], default_language: str | None = None) -> DataFrame:
    """quads with kind (type, relation, literal, error), ltype, value, lang and message."""
    is_type = F.col("p").isin(*type_predicates)
    literal = F.col("o_kind") == "literal"
    ltype = literal_type(F.col("o"), F.col("o_datatype"))
    typed = quads.withColumn("ltype", F.when(literal, ltype))
    message = (
        F.when(F.col("s_kind") == "blank", F.lit("the subject is a blank node"))
        .when(is_type & (F.col("o_kind") != "uri"), F.lit("the type isn't a URI"))
        .when(F.col("o_kind") == "blank", F.lit("the object is a blank node"))
        .when(literal & F.col("ltype").isNull(), F.concat(F.lit("not a value of "), F.coalesce("o_datatype", F.lit(""))))
    )
    lang = F.when(F.coalesce("o_lang", F.lit("")) != "", F.col("o_lang"))
    if default_language:
        lang = F.when(lang != default_language, lang)
    return typed.withColumn("message", message).select(
        *quads.columns,
        F.when(F.col("message").isNotNull(), "error").when(is_type, "type").when(literal, "literal").otherwise("relation").alias("kind"),
        "ltype",
        F.when(literal & F.col("message").isNull(), literal_value(F.col("o"), F.col("ltype"))).alias("value"),
        lang.alias("lang"),
        "message",
    )


def error_literals(classified: DataFrame) -> DataFrame:
    """uri, predicate, value: the subject, statement and message of every statement in error."""
    bad = classified.filter("kind = 'error'").withColumn("quad", statement_text())
    uri = F.concat(F.lit(ERROR_URI), F.url_encode("quad"))
    three = F.array(*[F.struct(F.lit(p).alias("predicate"), F.col(c).alias("value")) for p, c in ((ERROR_SUBJECT, "s"), (ERROR_QUAD, "quad"), (ERROR_MESSAGE, "message"))])
    return bad.select(uri.alias("uri"), F.explode(three).alias("x")).select("uri", "x.predicate", "x.value")


def collect_facts(quads: DataFrame, type_predicates: tuple[str, ...], graph: ClassGraph | None = None, config: InstanceConfig | None = None) -> Facts:
    config = config or InstanceConfig()
    return facts_of(classify(quads, type_predicates, config.default_language), graph, config)


def facts_of(classified: DataFrame, graph: ClassGraph | None = None, config: InstanceConfig | None = None) -> Facts:
    """The aggregates of classified quads; as there are three of them, ``classified`` should be written or cached."""
    config = config or InstanceConfig()
    spark = classified.sparkSession
    errors = error_literals(classified)
    none = F.lit(None).cast("string")

    values = classified.filter("kind = 'literal'").select(F.col("s").alias("uri"), F.col("p").alias("predicate"), "ltype", "lang", "value")
    values = values.unionByName(errors.select("uri", "predicate", F.lit("STRING").alias("ltype"), none.alias("lang"), "value"))
    # tags beside a known type are unusual but allowed; DATETIME and text keep their tag
    literals = values.groupBy("uri", "predicate", "ltype", "lang").agg(F.sort_array(F.collect_set("value")).alias("values"))
    relations = classified.filter("kind = 'relation'").select(F.col("s").alias("uri"), F.col("p").alias("predicate"), F.col("o").alias("object")).distinct()

    stated = classified.filter("kind = 'type'").select(F.col("s").alias("uri"), F.col("o").alias("type"))
    if config.add_super_types and graph is not None and graph.edges:
        closure = graph.closure(spark)
        stated = stated.join(closure, "type", "left").select("uri", F.coalesce("ancestor", "type").alias("type"))
    stated = stated.unionByName(errors.select("uri", F.lit(ERROR_TYPE).alias("type")))

    # every mentioned resource in one aggregate: null types mark those that are only mentioned
    mentioned = classified.filter("kind <> 'error'").select(F.col("s").alias("uri"), none.alias("type"))
    targets = classified.filter("kind = 'relation'").select(F.col("o").alias("uri"), none.alias("type"))
    instances = stated.unionByName(mentioned).unionByName(targets).groupBy("uri").agg(F.sort_array(F.collect_set("type")).alias("types"))
    instances = default_types(instances)
    types = instances.select("uri", F.explode("types").alias("type"))
    return Facts(types, literals, relations, instances)


def default_types(instances: DataFrame) -> DataFrame:
    """Untyped instances are resources."""
    return instances.withColumn("types", F.when(F.size("types") == 0, F.array(F.lit(RDFS_RESOURCE))).otherwise(F.col("types")))
