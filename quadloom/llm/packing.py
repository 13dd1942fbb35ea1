"""Best-fit-decreasing packing of token sequences: at any size the bins are those of best fit run piece by piece.

Pieces of equal length are exchangeable, and so are bins with equal space left. Best-fit decreasing over the whole corpus
therefore needs only the number of pieces of each length: at most ``capacity`` numbers, however many documents there are.
``plan`` runs it on the driver over that histogram. A segment tree over the remaining capacities holds how many bins are
open at each; the tightest bin that fits is found by one descent, in logarithmic time. Open bins of equal space are
ranges of sequence numbers, and a step fills a whole range: each of its bins as far as the length goes. The plan is a
list of intervals: of the pieces of length L, those ranked r to r+n go to sequences s to s+n at offset o. Its size depends
on the capacity alone.

Each piece then needs its rank among the pieces of its length: a count per (length, bucket) and a row number inside the
bucket, so the largest group (full pieces) is spread over many tasks.

Null text: a document of its closing id alone. Rows with one id are separate documents only if their texts differ in the
ids' CRC; equal rows are ranked in any order. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, materialise
from .tokens import encoder, vocabulary_path

CAPACITY = 1024
END_ID = 2


class SpaceTree:
    """A segment tree over remaining capacities 0..capacity: the smallest one not under ``need`` at which a bin is open."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, space: int, value: bool) -> None:
        i = space + self.size
        self.open[i] = value
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        i = need + self.size
        if self.open[i]:
            return need
        while i > 1:  # up to the first right neighbour that has an open bin, then down its left edge
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Intervals (length, rank, n, sequence, offset) by best-fit decreasing, sorted by length and rank.

    A bin that is the tightest for a length stays so while the length still fits it: what is left of it is less than any
    other bin that fits. So a bin takes floor(space / length) pieces before the next one does, and a range of bins of equal
    space is filled by that many layers of pieces at once; only the last bin of a length may take fewer.
    """
    tree, ranges, out, bins = SpaceTree(capacity), {}, [], 0

    def put(space: int, first: int, n: int) -> None:
        if space > 0 and n:
            ranges.setdefault(space, []).append((first, n))
            tree.set(space, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit {capacity}")
        while left:
            space = tree.tightest(length)
            if space is None:  # as many new bins as the rest needs
                space = capacity
                first, n = bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = ranges[space].pop()
                if not ranges[space]:
                    tree.set(space, False)
            each = space // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0  # pieces of the bin that isn't filled up
            for k in range(each if full else 0):
                out.append((length, rank + k * full, full, first, capacity - space + k * length))
            rank, left = rank + each * full, left - each * full
            for k in range(rest):
                out.append((length, rank + k, 1, first + full, capacity - space + k * length))
            rank, left = rank + rest, left - rest
            put(space, first + full + (rest > 0), n - full - (rest > 0))
            put(space - rest * length, first + full, 1 if rest else 0)
            put(space - each * length, first, full)
    table = np.array(out, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the first takes the remainder."""
    pieces = -(-n // capacity)
    head = n - capacity * (pieces - 1)
    return [(0, head), *((head + capacity * k, capacity) for k in range(pieces - 1))]


def token_pieces(docs: DataFrame, *, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32 of every document's pieces."""
    path = vocabulary or vocabulary_path()

    def run(batches):
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i in range(batch.num_rows):
                ids = np.append(enc.ids(batch.column(1)[i].as_py()), np.uint32(end_id))
                for k, (a, n) in enumerate(cut(len(ids), capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(ids[a : a + n]))
            columns = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, id_col: str = "doc_id", bucket_rows: int = 250_000, least_buckets: int = 16) -> DataFrame:
    """``pieces`` with sequence_id and offset, in as few sequences as best-fit decreasing finds."""
    rows = pieces.count()
    buckets = max(least_buckets, -(-rows // bucket_rows))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    sums = materialise(keyed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most ``capacity`` rows
    table = plan(counts, capacity)
    before = F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = keyed.withColumn("_place", F.row_number().over(W.partitionBy("length", "_bucket").orderBy(id_col, "piece", "ids_crc32"))).join(
        sums.select("length", "_bucket", before.alias("_before")), ["length", "_bucket"]
    )
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_place") - 1).alias("_rank"))
    span = 1 << 40
    keys, ranks, first, offset = table[:, 0] * span + table[:, 1], table[:, 1], table[:, 3], table[:, 4]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            own = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "_rank"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(first[at] + rank - ranks[at]), pa.array(offset[at])], names=names)

    names = [*pieces.columns, "sequence_id", "offset"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return arrow_map(ranked, run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, *, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack all documents."""
    return pack(materialise(token_pieces(docs, vocabulary=vocabulary, id_col=id_col, text_col=text_col), "pieces"), id_col=id_col)
