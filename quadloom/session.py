"""Session helpers that hold for every part of the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package (once per application), so that they need no shared install."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.suffix != ".zip" and root.is_dir():
        target = os.path.join(tempfile.mkdtemp(prefix="quadloom-ship-"), "quadloom.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"quadloom/{p.relative_to(root)}")
        spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); on one machine a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quadloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, compression: str = "snappy", options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut and lost executors cost nothing that was done."""
    path = f"{shared_dir(df.sparkSession)}/quadloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files behind a frame made by ``materialise`` once nothing lazy refers to it any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def storage_level(name: str) -> StorageLevel | None:
    """A storage level by its Spark name; NONE is None."""
    if name.upper() == "NONE":
        return None
    try:
        return getattr(StorageLevel, name.upper())
    except AttributeError:
        raise ValueError(f"unknown storage level {name!r}") from None


def keep(df: DataFrame, level: str) -> DataFrame:
    found = storage_level(level)
    return df if found is None else df.persist(found)


def keep_written(df: DataFrame, level: str) -> DataFrame:
    """A materialised frame at a storage level: its files are the copy on disk, so only levels that use memory add one."""
    found = storage_level(level)
    return df.persist(found) if found is not None and found.useMemory else df
