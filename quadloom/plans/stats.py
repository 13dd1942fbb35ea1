"""The stats job: URI frequencies of a source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import StatsConfig
from ..session import materialise
from ..operators.stats import count_by, distinct_uris, top_uris
from ..sources.nquads import read_quads


@dataclass
class Statistic:
    name: str
    counts: DataFrame
    top: DataFrame
    total: int


def run_stats(spark: SparkSession, source: str | DataFrame, config: StatsConfig | None = None) -> list[Statistic]:
    config = config or StatsConfig()
    quads = read_quads(spark, source, config.parser)[0] if isinstance(source, str) else source
    out = []
    for name in config.stats:
        counts = materialise(count_by(quads, name), "counts")  # read once for the top and the total
        out.append(Statistic(name, counts, top_uris(counts), distinct_uris(counts)))
    return out


def summary(stats: list[Statistic]) -> str:
    lines = []
    for s in stats:
        lines.append(f"{s.name}: {s.total} distinct URIs")
        lines += [f"  {r['count']:>12} {r['uri']}" for r in s.top.collect()]
    return "\n".join(lines)
