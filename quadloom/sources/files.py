"""Formats that are read file by file, as an Arrow-batched map over whole files; the suffix says which one it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .jsonld import parse_jsonld
from .nquads import QUAD_SCHEMA
from .rdfxml import parse_rdfxml
from .turtle import parse_turtle

READERS = {"turtle": parse_turtle, "rdfxml": parse_rdfxml, "jsonld": parse_jsonld}
#: Suffixes by format; any other file is read as Turtle, of which line-based statements are a part.
SUFFIXES = {"rdf": "rdfxml", "xml": "rdfxml", "owl": "rdfxml", "jsonld": "jsonld", "json": "jsonld"}
#: Rows of an output batch: a large file leaves in pieces.
PIECE = 10_000


def format_of(name: str) -> str:
    return SUFFIXES.get(name.lower().removesuffix(".gz").rpartition(".")[2], "turtle")


def parse_files(spark: SparkSession, path: str, syntax: str | None = None) -> DataFrame:
    """Quads of whole files (a file or folder, gzipped or not), plus ``line`` and ``ok`` as ``parse_lines`` has them; ``syntax`` overrides the suffixes."""
    if syntax is not None and syntax not in READERS:
        raise ValueError(f"unknown syntax {syntax!r}; there are {', '.join(READERS)}")
    ship_package(spark)
    name = F.input_file_name()
    files = spark.read.text(path, wholetext=True).select(F.hex(F.xxhash64(name)).alias("id"), name.alias("name"), "value")
    kinds = ["s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang", "g", "line", "ok"]

    def batch_of(rows):
        import pyarrow as pa

        types = [pa.string()] * 9 + [pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=kinds)

    def run(batches):
        for batch in batches:
            for file_id, file_name, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows = []
                for quad, bad in READERS[syntax or format_of(file_name)](text or "", file_id):
                    rows.append((*(quad or (None,) * 8), bad, bad is None))
                    if len(rows) >= PIECE:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, f"{QUAD_SCHEMA}, line string, ok boolean")
