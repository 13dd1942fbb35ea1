"""Shared pieces of the training-data operators: shared storage, Arrow slicing and the vectorised word scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, shared_dir, ship_package  # noqa: F401

#: Bytes of text that a Python worker handles as one numpy block; bounds its memory whatever the rows hold.
BLOCK_BYTES = 1 << 20


#: Bytes of an Arrow batch on its way to a Python worker; the session's own bound where that is lower.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with the package on the workers, batches of bounded bytes, and scratch memory given back after each task."""
    spark = df.sparkSession
    ship_package(spark)
    if _size(spark.conf.get(_BATCH_CONF, "64m")) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def bounded(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(bounded, schema)


def _size(text: str) -> int:
    number, unit = text.lower().rstrip("b").strip(), 1
    if number[-1:] in "kmgt":
        number, unit = number[:-1], 1 << (10 * ("kmgt".index(number[-1]) + 1))
    n = int(number) * unit
    return n if n > 0 else 1 << 62


def release_memory() -> None:
    """Freed pages of this process go back to the system (a worker is kept for later tasks, which may need none of them)."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``df`` has (whatever its case)."""
    used, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in used:
            n = f"_{n}"
        used.add(n.lower())
        out.append(n)
    return out


#: Rows of a frame that may be broadcast: a few longs each, 64 MB at most. Beyond, the same join runs by shuffle.
BROADCAST_ROWS = 1_000_000


def few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def drop_rows(df: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """``df`` without the rows whose ``keys`` are the columns of ``gone`` (materialised, nulls equal nulls): broadcast while few, joined by shuffle beyond."""
    mine = fresh(df, *(f"_key{i}" for i in range(len(keys))))
    theirs = [f"{m}_gone" for m in fresh(df.withColumns(dict(zip(mine, keys, strict=True))), *mine)]
    keyed, side = df.withColumns(dict(zip(mine, keys, strict=True))), gone.toDF(*theirs)
    match = F.lit(True)
    for m, t in zip(mine, theirs, strict=True):
        match = match & F.col(m).eqNullSafe(F.col(t))
    return keyed.join(F.broadcast(side) if few(gone) else side, match, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def keep_rows(df: DataFrame, id_col: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id is in ``wanted`` (one column, materialised): broadcast while few, joined by shuffle beyond."""
    return df.join(F.broadcast(wanted) if few(wanted) else wanted, id_col, "left_semi")


#: A key is hot beyond this many rows; the ``HOT_KEYS`` keys of most rows are taken out of the shuffle, so that much is broadcast at most.
HOT_ROWS, HOT_KEYS = 2000, 1000


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``left.join(right, keys)``, ``right`` unique by ``keys``: rows of hot keys stay where they are and meet a broadcast of the few hot rows of ``right``.

    ``left`` is read more than once, so it should be materialised. ``counts`` (keys and n) spares counting its keys. Every
    key has its rows; none is dropped or capped.
    """
    counts = counts if counts is not None else left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = counts.filter(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), *keys).limit(HOT_KEYS).select(*keys).collect()
    if not hot:
        return left.join(right, keys, how)
    found = F.broadcast(left.sparkSession.createDataFrame(hot, left.select(*keys).schema))
    cold = left.join(found, keys, "left_anti").join(right, keys, how)
    return cold.unionByName(left.join(found, keys, "left_semi").join(F.broadcast(right.join(found, keys, "left_semi")), keys, how))


def one_of_each(df: DataFrame, keys: list[Column]) -> DataFrame:
    """``df`` with one row of those that agree in ``keys`` (nulls equal nulls); rows without a double aren't moved."""
    names = fresh(df, *(f"_same{i}" for i in range(len(keys))))
    again = df.select(*[k.alias(n) for n, k in zip(names, keys, strict=True)]).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*names)
    again = materialise(again, "repeated")
    if not again.limit(1).count():
        return df
    keyed = df.withColumns(dict(zip(names, keys, strict=True)))
    side = again.toDF(*(f"{n}_again" for n in names))
    match = F.lit(True)
    for n in names:
        match = match & F.col(n).eqNullSafe(F.col(f"{n}_again"))
    single = keyed.join(side, match, "left_semi").dropDuplicates(names).drop(*names)
    return drop_rows(df, keys, again).unionByName(single)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by Spark alone; the package goes to the workers with the first read."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(sizes: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[slice]:
    """Consecutive row slices of at most ``limit`` bytes each (a single larger row stands alone)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield slice(start, len(sizes))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Of an Arrow string array: its UTF-8 bytes and the n+1 offsets into them; null counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if column.null_count or not pa.types.is_large_string(column.type) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


#: Lower-cased byte for each byte of a word (ASCII digits, letters and every byte of a non-ASCII character), else 0.
WORD_BYTE = np.zeros(256, np.uint8)
for _b in range(256):
    if 48 <= _b <= 57 or 97 <= _b <= 122 or _b >= 128:
        WORD_BYTE[_b] = _b
    elif 65 <= _b <= 90:
        WORD_BYTE[_b] = _b + 32


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser over a uint64 array."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out, p = np.empty(n, np.uint64), 1
    for i in range(n):
        out[i] = p
        p = p * base & 0xFFFFFFFFFFFFFFFF
    return out


_BASE = 0x9E3779B97F4A7C15 | 1
_POW = _powers(_BASE, 64)


def scan_words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of a block of texts: 64-bit hash, start and end byte of each, and for each text the index of its first word (n+1).

    A word is a run of ASCII digits and letters (lower-cased) and non-ASCII characters; words end at text borders.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    low = WORD_BYTE[raw]
    is_word = low != 0
    edge = np.empty(n, bool)
    edge[0] = is_word[0]
    np.logical_and(is_word[1:], ~is_word[:-1], out=edge[1:])
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    edge[inner] = is_word[inner]
    stop = np.empty(n, bool)
    stop[-1] = is_word[-1]
    np.logical_and(is_word[:-1], ~is_word[1:], out=stop[:-1])
    stop[inner - 1] = is_word[inner - 1]
    starts = np.flatnonzero(edge)
    ends = np.flatnonzero(stop) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, np.zeros(len(offs), np.int64)
    length = ends - starts
    # position of each word byte inside its word, wrapped at 64: long words stay exact in order because the wrap index is mixed in
    at = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)), axis=0) if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], n) - np.repeat(starts, np.diff(np.append(starts, n)))])
    with np.errstate(over="ignore"):
        value = mix_bytes(low, at)
        value[~is_word] = 0
        hashes = np.add.reduceat(value, starts)
        hashes = mix64(hashes + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, starts, ends, np.searchsorted(starts, offs)


def mix_bytes(low: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A uint64 for each (byte, place in its word): a table for the first 64 places, mixed directly beyond."""
    out = _BYTE_TABLE[(np.minimum(at, 63) << 8) | low]
    far = np.flatnonzero(at >= 63)
    if len(far):
        with np.errstate(over="ignore"):
            out[far] = mix64((at[far].astype(np.uint64) << np.uint64(8)) + low[far] + np.uint64(_BASE))
    return out


with np.errstate(over="ignore"):
    _BYTE_TABLE = mix64((np.arange(64 * 256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))


def string_hash(text):
    """A 60-bit hash that any SQL engine can compute too: the first 15 hex digits of the MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
