"""Filters over quads and instances. Sets of resources are frames throughout: a join, never a driver-side set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import InstanceFilterConfig, QuadFilterConfig
from ..session import materialise


def resource_frame(spark: SparkSession, uris) -> DataFrame:
    return spark.createDataFrame([(u,) for u in sorted(set(uris))], "uri string")


def by_subjects(quads: DataFrame, resources: DataFrame) -> DataFrame:
    """Quads whose subject is a URI of ``resources``."""
    return quads.filter("s_kind = 'uri'").join(resources.select(F.col("uri").alias("s")), "s", "left_semi").select(*quads.columns)


def without_subjects(quads: DataFrame, resources: DataFrame) -> DataFrame:
    """Quads whose subject isn't a URI of ``resources``; blank subjects stay."""
    gone = resources.select(F.col("uri").alias("_s"))
    return quads.join(gone, (F.col("s") == F.col("_s")) & (F.col("s_kind") == "uri"), "left_anti")


def by_objects(quads: DataFrame, resources: DataFrame) -> DataFrame:
    """Quads whose object is a URI of ``resources``."""
    return quads.filter("o_kind = 'uri'").join(resources.select(F.col("uri").alias("o")), "o", "left_semi").select(*quads.columns)


def type_statements(quads: DataFrame, type_predicates: tuple[str, ...]) -> DataFrame:
    return quads.filter(F.col("p").isin(*type_predicates) & (F.col("o_kind") == "uri"))


def subjects_of_type(quads: DataFrame, types: DataFrame, type_predicates: tuple[str, ...]) -> DataFrame:
    """The URI subjects (column uri) of any of ``types`` (column uri)."""
    return by_objects(type_statements(quads, type_predicates), types).filter("s_kind = 'uri'").select(F.col("s").alias("uri")).distinct()


def neighbours(quads: DataFrame, resources: DataFrame, directed: bool = True) -> DataFrame:
    """URI objects of the resources' statements and, if not directed, URI subjects of statements about them (column uri)."""
    found = by_subjects(quads, resources).filter("o_kind = 'uri'").select(F.col("o").alias("uri"))
    if not directed:
        found = found.unionByName(by_objects(quads, resources).filter("s_kind = 'uri'").select(F.col("s").alias("uri")))
    return found.distinct()


def neighbourhood(quads: DataFrame, resources: DataFrame, depth: int, directed: bool = True) -> DataFrame:
    """Resources within ``depth`` hops. Only what the last hop found is followed; each hop's set is written, so plans stay short."""
    seen = frontier = resources.select("uri").distinct()
    for _ in range(depth):
        frontier = materialise(neighbours(quads, frontier, directed).join(seen, "uri", "left_anti"), "hop")
        seen = seen.unionByName(frontier)
    return seen


def filter_quads(quads: DataFrame, config: QuadFilterConfig) -> DataFrame:
    """The resource filter: no resources keep everything; the blacklist is always taken away."""
    config.validate()
    spark = quads.sparkSession
    black = resource_frame(spark, config.blacklist) if config.blacklist else None
    if not config.resources:
        return quads if black is None else without_subjects(quads, black)
    allowed = neighbourhood(quads, resource_frame(spark, config.resources), config.related_depth, config.directed)
    return by_subjects(quads, allowed if black is None else allowed.join(black, "uri", "left_anti"))


def filter_instances(instances: DataFrame, config: InstanceFilterConfig, known_types=None) -> DataFrame:
    """Instances (column types: array) with an accepted type; other types go too if ``ignore_other_types``.

    ``known_types``: the data's types; an accepted type that isn't among them is an error.
    """
    if not config.types:
        return instances
    if known_types is not None and (unknown := sorted(set(config.types) - set(known_types))):
        raise ValueError(f"no such type: {', '.join(unknown)}")
    accepted = F.array(*[F.lit(t) for t in sorted(set(config.types))])
    kept = instances.filter(F.arrays_overlap("types", accepted))
    return kept.withColumn("types", F.array_intersect("types", accepted)) if config.ignore_other_types else kept


def has_type(instances: DataFrame) -> DataFrame:
    return instances.filter(F.size("types") > 0)
