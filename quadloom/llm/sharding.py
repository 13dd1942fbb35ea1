"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

At each level every child makes a weighted draw ``-ln(u) / weight``, ``u`` hashed from the document id and the child's
own name; the smallest draw wins. A child's draw depends on nothing but the id, its name and its weight, so when one
weight grows, documents move only into that child, and when it shrinks only out of it: movement stays inside the
subtrees whose weights change. A new shard opens a region of its own, hence it takes documents and no other shard does.

Everything is a JVM expression. Places inside a shard (``slot``) come from counts of (shard, bucket) and a row number
inside each bucket, so no shard is ever gathered in one task.

Defined results: null ids hash as a fixed value and share a shard; null text is empty; other columns are not read; rows with one id share a shard;
rows that are fully equal get different slots in unspecified order; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialise, string_hash


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


@dataclass(frozen=True)
class Topology:
    """The leaves of the tree; the weight of a rack or region is the sum of its shards'."""

    shards: tuple[Shard, ...]

    @staticmethod
    def uniform(n_shards: int, regions: int = 4, racks: int = 5) -> Topology:
        """``n_shards`` of weight 1 dealt evenly over the regions and racks."""
        return Topology(tuple(Shard(i, f"region{i % regions}", f"rack{i // regions % racks}") for i in range(n_shards)))

    def grown(self, weight: float = 1.0) -> Topology:
        """One more shard, in a region of its own."""
        number = max((s.number for s in self.shards), default=-1) + 1
        return Topology((*self.shards, Shard(number, f"region+{number}", "rack0", weight)))

    def reweighted(self, number: int, weight: float) -> Topology:
        return Topology(tuple(replace(s, weight=weight) if s.number == number else s for s in self.shards))

    def children(self) -> tuple[dict[str, float], dict[str, dict[str, float]], dict[str, dict[str, float]]]:
        regions: dict[str, float] = {}
        racks: dict[str, dict[str, float]] = {}
        leaves: dict[str, dict[str, float]] = {}
        for s in self.shards:
            if s.weight > 0:
                regions[s.region] = regions.get(s.region, 0.0) + s.weight
                own = racks.setdefault(s.region, {})
                own[s.rack] = own.get(s.rack, 0.0) + s.weight
                leaves.setdefault(f"{s.region}/{s.rack}", {})[str(s.number)] = s.weight
        return regions, racks, leaves


def _nodes(children: dict[str, float]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(w)).alias("weight")) for k, w in sorted(children.items())])


def _pick(key: Column, level: str, parent: Column, children: Column) -> Column:
    def draw(c: Column) -> Column:
        # 60 bits of the hash give u strictly between 0 and 1
        u = (string_hash(F.concat_ws("|", key, F.lit(level), parent, c["name"])).cast("double") + 0.5) / float(2**60)
        return F.struct((-F.ln(u) / c["weight"]).alias("draw"), c["name"].alias("name"))

    return F.array_min(F.transform(children, draw))["name"]


def key_text(key: Column) -> Column:
    """What is hashed for a key of any type; null is a value of its own."""
    return F.coalesce(key.cast("string"), F.lit("null key"))


def assign(df: DataFrame, topology: Topology, key: Column, out: str = "shard") -> DataFrame:
    """Add ``out`` (a column of that name is replaced): the number of the shard that ``key`` descends to."""
    regions, racks, leaves = topology.children()
    if not regions:
        raise ValueError("the tree has no shard of positive weight")
    table = lambda m: F.create_map(*[x for k, v in sorted(m.items()) for x in (F.lit(k), _nodes(v))])
    text, region, rack = fresh(df, "_key", "_region", "_rack")
    return (
        df.withColumn(text, key_text(key))
        .withColumn(region, _pick(F.col(text), "region", F.lit(""), _nodes(regions)))
        .withColumn(rack, F.concat_ws("/", F.col(region), _pick(F.col(text), "rack", F.col(region), F.element_at(table(racks), F.col(region)))))
        .withColumn(out, _pick(F.col(text), "shard", F.col(rack), F.element_at(table(leaves), F.col(rack))).cast("int"))
        .drop(text, region, rack)
    )


def shard_documents(docs: DataFrame, topology: Topology, *, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 500_000, least_buckets: int = 64) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard and group_id (equal texts, equal value).

    Buckets are dealt by id and text, so rows that share an id (or have none) are spread as well.
    """
    n_shards = len(topology.shards)
    rows = docs.select(F.col(id_col)).count()
    buckets = max(least_buckets, math.ceil(rows / (n_shards * bucket_rows)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    group = string_hash(text)
    bucket = F.pmod(string_hash(F.concat_ws("|", key_text(F.col("_id")), F.col("group_id").cast("string"))), F.lit(buckets)).cast("int")
    read = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"), group.alias("group_id")
    )
    # texts are read once; what is left of them is written, as counts and rows need it
    placed = materialise(assign(assign(read, topology, F.col("_id")), topology.grown(), F.col("_id"), "grown_shard").withColumn("_bucket", bucket), "placed")
    counts = placed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(W.partitionBy("shard", "_bucket").orderBy("_id", "text_crc32", "group_id"))
    return (
        placed.withColumn("_place", place)
        .join(first, ["shard", "_bucket"])
        .select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_place") - 1).cast("long").alias("slot"), "grown_shard", "group_id")
    )
