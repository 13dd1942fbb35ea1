"""The RDF schema of a set of quads: types, predicates, labels and the class graph.

One pass collects what is of the schema's size: predicates, types and class edges. Edges that would close a cycle are
dropped in the order of their URIs; only edges in or between cycles are looked at for that. The closure is a frame.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import ERROR_PREDICATES, ERROR_TYPE, RDFS_LABEL, RDFS_RESOURCE, RdfConfig
from ..session import materialise
from .filters import type_statements


class ClassGraph:
    """A DAG of class URIs, edges from superclass to subclass."""

    def __init__(self, edges=(), classes=()) -> None:
        self.supers: dict[str, set[str]] = {c: set() for c in classes}
        self.subs: dict[str, set[str]] = {c: set() for c in classes}
        self.skipped: list[tuple[str, str]] = []
        ordered = sorted(set(edges))
        suspect = _in_or_between_cycles(ordered)  # only edges between these can close a cycle
        for sup, sub in ordered:
            self.add(sup, sub, sup in suspect and sub in suspect)

    def add(self, sup: str, sub: str, check: bool = True) -> bool:
        for c in (sup, sub):
            self.supers.setdefault(c, set())
            self.subs.setdefault(c, set())
        if sup == sub or check and sub in self.super_classes(sup):
            self.skipped.append((sup, sub))
            return False
        self.supers[sub].add(sup)
        self.subs[sup].add(sub)
        return True

    @property
    def classes(self) -> list[str]:
        return sorted(self.supers)

    @property
    def edges(self) -> list[tuple[str, str]]:
        return sorted((a, b) for a, subs in self.subs.items() for b in subs)

    def super_classes(self, c: str) -> set[str]:
        """All ancestors."""
        seen, todo = set(), list(self.supers.get(c, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += self.supers[x]
        return seen

    def has_super_classes(self, c: str) -> bool:
        return bool(self.supers.get(c))

    def has_sub_classes(self, c: str) -> bool:
        return bool(self.subs.get(c))

    def super_class_first(self) -> list[str]:
        """Topological order, ties by URI."""
        import heapq

        waiting = {c: len(s) for c, s in self.supers.items()}
        ready = [c for c, n in waiting.items() if not n]
        heapq.heapify(ready)
        out = []
        while ready:
            c = heapq.heappop(ready)
            out.append(c)
            for s in self.subs[c]:
                waiting[s] -= 1
                if not waiting[s]:
                    heapq.heappush(ready, s)
        return out

    def keep_only(self, classes) -> ClassGraph:
        """Without the other classes; their edges vanish, nothing is bridged."""
        kept = set(classes)
        return ClassGraph([(a, b) for a, b in self.edges if a in kept and b in kept], [c for c in self.classes if c in kept])

    def edge_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.edges, "super string, sub string")

    def closure(self, spark: SparkSession) -> DataFrame:
        """(type, ancestor) of every class and each of its ancestors, itself included: paths are doubled by joins, so it never stands on the driver."""
        edges = self.edge_frame(spark)
        step = edges.select(F.col("sub").alias("type"), F.col("super").alias("ancestor")).distinct()
        found = materialise(step, "closure")
        size, before = found.count(), 0
        while size != before:
            onward = found.select(F.col("type").alias("ancestor"), F.col("ancestor").alias("above"))
            found = materialise(found.unionByName(found.join(onward, "ancestor").select("type", F.col("above").alias("ancestor"))).distinct(), "closure")
            size, before = found.count(), size
        own = spark.createDataFrame([(c,) for c in self.classes], "type string").select("type", F.col("type").alias("ancestor"))
        return found.unionByName(own)


def _in_or_between_cycles(edges: list[tuple[str, str]]) -> set[str]:
    """The classes that are left when those without superclasses, then those without subclasses, are taken away again and again."""
    left = {c for e in edges for c in e}
    for a, b in ((0, 1), (1, 0)):
        waiting, onward = dict.fromkeys(left, 0), {c: [] for c in left}
        for e in edges:
            if e[a] in left and e[b] in left:
                waiting[e[b]] += 1
                onward[e[a]].append(e[b])
        ready = [c for c, n in waiting.items() if not n]
        while ready:
            c = ready.pop()
            left.discard(c)
            for x in onward[c]:
                waiting[x] -= 1
                if not waiting[x]:
                    ready.append(x)
    return left


def type_index(quads: DataFrame, config: RdfConfig) -> DataFrame:
    """type_URI: objects of type and subclass statements, and the special types."""
    spark = quads.sparkSession
    found = type_statements(quads, (*config.all_type_predicates, *config.all_subclass_predicates)).select(F.col("o").alias("type_URI"))
    return found.unionByName(spark.createDataFrame([(ERROR_TYPE,), (RDFS_RESOURCE,)], "type_URI string")).distinct()


def predicate_index(quads: DataFrame) -> DataFrame:
    """predicate (int, from 0 in URI order) and predicate_URI, the error predicates included. The window runs over the distinct
    predicates only, whose number is the schema's, not the data's."""
    spark = quads.sparkSession
    found = quads.select(F.col("p").alias("predicate_URI")).unionByName(spark.createDataFrame([(p,) for p in ERROR_PREDICATES], "predicate_URI string")).distinct()
    return found.select((F.row_number().over(W.orderBy("predicate_URI")) - 1).alias("predicate"), "predicate_URI")


def labels(quads: DataFrame, uris: DataFrame) -> DataFrame:
    """uri, label: of several labels the one of least (language, text); labels that aren't literals don't count."""
    found = quads.filter((F.col("p") == RDFS_LABEL) & (F.col("o_kind") == "literal") & (F.col("s_kind") == "uri")).select(F.col("s").alias("uri"), F.coalesce("o_lang", F.lit("")).alias("lang"), "o")
    return found.join(uris.select("uri").distinct(), "uri", "left_semi").groupBy("uri").agg(F.min(F.struct("lang", "o")).alias("x")).select("uri", F.col("x.o").alias("label"))


def class_edges(quads: DataFrame, config: RdfConfig) -> DataFrame:
    """(super, sub) of subclass statements whose subject is a type."""
    types = type_index(quads, config).withColumnRenamed("type_URI", "sub")
    stated = type_statements(quads, config.all_subclass_predicates).filter("s_kind = 'uri'").select(F.col("o").alias("super"), F.col("s").alias("sub"))
    return stated.join(types, "sub", "left_semi").distinct()


@dataclass
class RdfSchema:
    config: RdfConfig
    types: list[str]
    predicates: list[str]  # in the order of their numbers
    labels: dict[str, str]
    graph: ClassGraph

    def predicate_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.predicates)), "predicate int, predicate_URI string")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("config", json.dumps(self._fingerprint(), sort_keys=True)), *(("type", t) for t in self.types), *(("predicate", p) for p in self.predicates)]
        rows += [("label", json.dumps([k, v])) for k, v in sorted(self.labels.items())] + [("edge", json.dumps(e)) for e in self.graph.edges]
        spark.createDataFrame(rows, "kind string, value string").coalesce(1).write.parquet(path)

    def _fingerprint(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self.config).items() if k != "cache_file"}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_schema(spark: SparkSession, path: str, config: RdfConfig) -> RdfSchema:
    rows = spark.read.parquet(path).collect()
    of = lambda kind: [r["value"] for r in rows if r["kind"] == kind]
    schema = RdfSchema(config, sorted(of("type")), sorted(of("predicate")), dict(map(json.loads, of("label"))), ClassGraph(map(tuple, map(json.loads, of("edge"))), sorted(of("type"))))
    if json.dumps(schema._fingerprint(), sort_keys=True) != of("config")[0]:
        raise ValueError(f"the schema cached at {path} was collected with other settings")
    return schema


def collect_schema(quads: DataFrame, config: RdfConfig) -> RdfSchema:
    """The schema of all quads; read from the cache folder if there is one, written to it else."""
    spark = quads.sparkSession
    if config.cache_file and _exists(spark, config.cache_file):
        return load_schema(spark, config.cache_file, config)
    # one pass for everything whose size is the schema's: predicates, types and class edges
    is_type, is_sub = (F.col("p").isin(*x) & (F.col("o_kind") == "uri") for x in (config.all_type_predicates, config.all_subclass_predicates))
    fact = lambda kind, a, b=None: F.struct(F.lit(kind).alias("kind"), a.alias("a"), (F.lit(None).cast("string") if b is None else b).alias("b"))
    parts = F.array(fact("predicate", F.col("p")), F.when(is_type | is_sub, fact("type", F.col("o"))), F.when(is_sub & (F.col("s_kind") == "uri"), fact("edge", F.col("o"), F.col("s"))))
    rows = quads.select(F.explode(F.array_compact(parts)).alias("x")).select("x.*").distinct().collect()
    types = sorted({r["a"] for r in rows if r["kind"] == "type"} | {ERROR_TYPE, RDFS_RESOURCE})
    predicates = sorted({r["a"] for r in rows if r["kind"] == "predicate"} | set(ERROR_PREDICATES))
    names = {}
    if config.collect_labels and RDFS_LABEL in predicates:
        names = {r["uri"]: r["label"] for r in labels(quads, spark.createDataFrame([(u,) for u in sorted({*types, *predicates})], "uri string")).collect()}
    known = set(types)
    edges = [(r["a"], r["b"]) for r in rows if r["kind"] == "edge" and r["b"] in known] if config.collect_subclass_graph else []
    schema = RdfSchema(config, types, predicates, names, ClassGraph(edges, types))
    if config.cache_file:
        schema.save(spark, config.cache_file)
    return schema
