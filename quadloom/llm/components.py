"""Connected components of a link table, by contraction: all steps are joins and aggregates.

In a round every node points to its least neighbour if that is less than itself; pointers are doubled until they rest, and
the links are carried over to the roots. Roots and hubs may be hot; their joins are split. Ids may be of any type with an order. Nodes that are still linked halve at least, so rounds are logarithmic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialise


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links`` (columns a, b; a null, loops and repeats do no harm); root is the least id of its component."""
    edges = materialise(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found: DataFrame | None = None
    while edges.limit(1).count():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointer = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")), "pointers")
        while True:
            onward = pointer.select(F.col("id").alias("root"), F.col("root").alias("next"))
            doubled = materialise(hot_join(pointer, onward, ["root"]).select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "pointers")
            pointer = doubled.select("id", "root")
            if not doubled.filter("moved").limit(1).count():
                break
        to = lambda c: pointer.select(F.col("id").alias(c), F.col("root").alias(f"_{c}"))
        edges = materialise(hot_join(edges, to("a"), ["a"]).join(to("b"), "b").filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
        if found is None:
            found = pointer
        else:
            # what pointed to a node of this round now points to its root
            moved = pointer.select(F.col("id").alias("root"), F.col("root").alias("_to"))
            found = materialise(found.join(moved, "root", "left").select("id", F.coalesce("_to", "root").alias("root")), "roots")
    return found if found is not None else links.select(F.col("a").alias("id"), F.col("b").alias("root")).limit(0)
