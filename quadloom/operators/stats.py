"""URI frequencies: counts by subject, predicate or object, the most frequent ones and how many there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP = 100
STATS = {"SUBJECT_URI_COUNT": ("s", "s_kind = 'uri'"), "PREDICATE_URI_COUNT": ("p", "true"), "OBJECT_URI_COUNT": ("o", "o_kind = 'uri'")}


def count_by(quads: DataFrame, stat: str) -> DataFrame:
    """uri, count of a statistic."""
    if stat not in STATS:
        raise ValueError(f"unknown statistic {stat!r}; there are {', '.join(STATS)}")
    column, condition = STATS[stat]
    return quads.filter(condition).groupBy(F.col(column).alias("uri")).agg(F.count(F.lit(1)).alias("count"))


def top_uris(counts: DataFrame, n: int = TOP) -> DataFrame:
    """The ``n`` most frequent, ties by URI: a heap per partition, no global sort."""
    return counts.orderBy(F.desc("count"), "uri").limit(n)


def distinct_uris(counts: DataFrame) -> int:
    return counts.count()


def approximate_distinct(quads: DataFrame, stat: str, error: float = 0.02) -> DataFrame:
    """One row: about how many URIs there are, from a sketch; no URI is shuffled."""
    column, condition = STATS[stat]
    return quads.filter(condition).agg(F.approx_count_distinct(column, error).alias("n_uris"))
