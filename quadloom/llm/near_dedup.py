"""Near-duplicate classes by BagMinHash: documents whose multisets of five-word shingles have a weighted Jaccard similarity
of at least 0.8 are linked; classes are the connected components.

A node is a pair of id and text (its hash), so rows that share an id but not a text are nodes of their own.

1. Texts of equal words are one: the least node stands for them from here on.
2. Signatures of 128 slots are cut into 32 bands of 4; a pair of similarity 0.8 misses all bands once in 2e7.
3. In each bucket all members are compared with one leader, the member that meets the most others in all its buckets:
   for copies of one text that is the text itself or close to it.
4. Components of these links. In buckets that still hold several components, every member outside the leader's component
   is compared with all members of other components: so each pair of a bucket is either compared or already known to be of
   one class. A pair is compared in the first band that it shares.
5. Components again.

A comparison is the same everywhere and at every size: the signatures must agree in 58 % of their slots (six standard
deviations below 0.8; one pair in 1e9 falls short), then the multisets themselves decide. Both steps run in ``compare``:
two sides of a group meet in one sorted stream, of which only the first side is held. Groups are salted chunks of a
leader's pairs, or blocks of a bucket by blocks; the chunk or block is dealt by a hash, so a group of any number of
copies is spread over many tasks, and what comes out are links, never all pairs. Beyond the links the work grows with the
pairs of a bucket that are not of one class.

Null, empty and wordless texts are classes of their own; texts of fewer than five words are one shingle; rows equal in id
and text are one node, of which one row is kept; null ids come behind all others and have classes like them. An empty
table has no classes. Ids may be of any type that has an order. All steps are joins, aggregates and block-wise numpy;
links, signatures and components stay distributed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bagminhash import SLOTS, compact, overlaps, shingles, signatures
from .common import arrow_map, blocks, hot_join, keep_rows, materialise, mix64, scan_words, text_bytes
from .components import components

THRESHOLD = 0.8
ESTIMATE = 0.58
#: Members of a block of a bucket, bytes of the multisets that the held side of a group may have, pairs of a chunk.
BLOCK, BLOCK_BAGS, CHUNK_PAIRS = 512, 4 << 20, 50_000


def node(id_col: str, text_col: str) -> Column:
    """The node of a row: ordered by id, null ids last, then by the text's hash."""
    return F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"), F.xxhash64(text_col).alias("t"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(node(id_col, text_col).alias("id"), F.col(text_col).alias("text"))


def _kind(df: DataFrame, column: str = "id") -> str:
    return df.schema[column].dataType.simpleString()


def signature_table(texts: DataFrame) -> DataFrame:
    """id, k1, k2 (the words' 128-bit hash), bands (32 keys of 64 bits), sig (slots of 16 bits), size (bytes of its multiset); rows without words are left out."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, offs = text_bytes(batch.column(1))
            for rows in blocks(np.diff(offs) + 160):  # 1 MB of at least 160 bytes each: fewer rows than a block may have
                own = offs[rows.start : rows.stop + 1]
                n = rows.stop - rows.start
                part, base = raw[own[0] : own[-1]], own - own[0]
                doc, key, count, n_words = shingles(part, base)
                words, _, _, first = scan_words(part, base)
                k1, k2 = _sequence_hash(words, first)
                some = np.flatnonzero(n_words > 0)
                if not len(some):
                    continue
                sig, bands = compact(signatures(doc, key, count, n)[some])
                size = 12 * np.bincount(doc, minlength=n)[some]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(rows.start, n).take(pa.array(some)), pa.array(k1[some].view(np.int64)), pa.array(k2[some].view(np.int64)),
                        pa.array([x.tobytes() for x in bands], pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(size, pa.int64()),
                    ],
                    names=["id", "k1", "k2", "bands", "sig", "size"],
                )

    return arrow_map(texts, run, f"id {_kind(texts)}, k1 long, k2 long, bands binary, sig binary, size long")


def _sequence_hash(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence."""
    n_words = np.diff(first)
    out = []
    at = (np.arange(len(words)) - np.repeat(first[:-1], n_words)).astype(np.uint64)
    for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        with np.errstate(over="ignore"):
            v = np.concatenate([[0], np.cumsum(mix64(words + mix64(at + np.uint64(salt))))]).astype(np.uint64)
            out.append(mix64(v[first[1:]] - v[first[:-1]] + n_words.astype(np.uint64)))
    return out[0], out[1]


def band_keys(sigs: DataFrame) -> DataFrame:
    """id, band, bucket, size: a row for each band of each node."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            n, m = keys.shape
            row = pa.array(np.repeat(np.arange(n), m))
            band = np.tile(np.arange(m), n)
            with np.errstate(over="ignore"):
                bucket = mix64(keys.reshape(-1) + np.uint64(0x9E3779B97F4A7C15) * band.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(band, pa.int32()), pa.array(bucket.view(np.int64)), batch.column(2).take(row)], names=["id", "band", "bucket", "size"])

    return arrow_map(sigs.select("id", "bands", "size"), run, f"id {_kind(sigs)}, band int, bucket long, size long")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """id, weight and the multiset: sorted 64-bit keys, then 32-bit counts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, offs = text_bytes(batch.column(1))
            for rows in blocks(np.diff(offs) + 160):
                own = offs[rows.start : rows.stop + 1]
                n = rows.stop - rows.start
                doc, key, count, _ = shingles(raw[own[0] : own[-1]], own - own[0])
                cut = np.searchsorted(doc, np.arange(n + 1))
                sets = [key[a:b].tobytes() + count[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                weight = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, n), pa.array(weight), pa.array(sets, pa.binary())], names=["id", "weight", "bag"])

    return arrow_map(texts, run, f"id {_kind(texts)}, weight long, bag binary")


def likely(pairs: DataFrame, sigs: DataFrame, least: float = ESTIMATE) -> DataFrame:
    """The pairs (leader, id) whose signatures agree in a share of at least ``least`` slots; ``leader`` may be hot."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SLOTS) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(1) >= least * SLOTS))

    mine = materialise(pairs.join(sigs.select("id", "sig"), "id"), "pairs")
    both = hot_join(mine, sigs.select(F.col("id").alias("leader"), F.col("sig").alias("lead_sig")), ["leader"])
    return arrow_map(both.select("leader", "id", "sig", "lead_sig"), run, f"leader {_kind(sigs)}, id {_kind(sigs)}")


class _Side:
    """Rows of one side of a group: nodes, hashes of their components, bands, signatures, weights and multisets."""

    def __init__(self, batch, rows: slice) -> None:
        n = rows.stop - rows.start
        column = lambda k: batch.column(k).slice(rows.start, n)
        self.n, self.id = n, column(2)
        self.root, self.band, self.weight = (column(k).to_numpy() for k in (3, 4, 7))
        self.bands = np.frombuffer(b"".join(column(5).to_pylist()), np.int64).reshape(n, -1)
        self.sig = np.frombuffer(b"".join(column(6).to_pylist()), np.uint16).reshape(n, SLOTS)
        self.bags = column(8).to_pylist()

    def bag(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        raw = self.bags[i]
        n = len(raw) // 12
        return np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint32, n, 8 * n)


def _links(left: _Side, right: _Side, threshold: float) -> tuple[list[int], list[int]]:
    """(row of left, row of right) of the pairs of different components that are linked, each in its first shared band."""
    out: tuple[list[int], list[int]] = ([], [])
    for i in range(left.n):
        agree = (right.sig == left.sig[i]).sum(1)
        near = np.flatnonzero((agree >= ESTIMATE * SLOTS) & (right.root != left.root[i]))
        if left.band[i] >= 0 and len(near):
            near = near[(right.bands[near] == left.bands[i]).argmax(1) == left.band[i]]
        lo, hi = np.minimum(right.weight[near], left.weight[i]), np.maximum(right.weight[near], left.weight[i])
        near = near[lo >= threshold * hi - 1e-9]  # the similarity is at most their ratio
        if not len(near):
            continue
        parts = [right.bag(j) for j in near.tolist()]
        starts = np.cumsum([0] + [len(k) for k, _ in parts])[:-1]
        both = overlaps(left.bag(i), np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]), starts)
        good = near[both >= threshold * (left.weight[i] + right.weight[near] - both) - 1e-9]
        out[0].extend([i] * len(good))
        out[1].extend(good.tolist())
    return out


def compare(left: DataFrame, right: DataFrame, sigs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) between the two sides of every group.

    Both frames: g (the group), id, root (hash of the node's component), band (the band of the bucket; -1 where any will do).
    The left side of a group is held in memory, the right one streams by.
    """
    kind = _kind(sigs)
    data = sigs.select("id", "bands", "sig").join(sets, "id")
    rows = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    rows = rows.join(data, "id").select("g", "side", "id", "root", "band", "bands", "sig", "weight", "bag").repartition("g").sortWithinPartitions("g", "side")

    def run(batches):
        import pyarrow as pa

        group, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            g, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            turn = np.flatnonzero((np.diff(g) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *turn.tolist()], [*turn.tolist(), batch.num_rows], strict=True):
                if g[a] != group:
                    group, held = g[a], []
                own = _Side(batch, slice(a, b))
                if side[a] == 0:
                    held.append(own)
                    continue
                for other in held:
                    i, j = _links(other, own, threshold)
                    if i:
                        yield pa.RecordBatch.from_arrays([other.id.take(pa.array(i)), own.id.take(pa.array(j))], names=["x", "y"])

    found = arrow_map(rows, run, f"x {kind}, y {kind}")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _sets(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Multisets of the texts of ``nodes`` (column id)."""
    needed = materialise(nodes.select("id").distinct(), "needed")
    return materialise(shingle_sets(keep_rows(texts, "id", needed)).dropDuplicates(["id"]), "bags")


def star_links(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (leader, id) that are linked. A leader's pairs are dealt in chunks; its multiset goes to each chunk once."""
    pairs = materialise(likely(pairs, sigs).distinct(), "likely")
    chunks = max(16, -(-pairs.count() // CHUNK_PAIRS))
    g = F.xxhash64("leader", F.pmod(F.xxhash64("id"), F.lit(chunks)))
    right = pairs.select(g.alias("g"), "id", F.xxhash64("id").alias("root"), F.lit(-1).alias("band"))
    left = pairs.select(g.alias("g"), F.col("leader").alias("id"), F.xxhash64("leader").alias("root"), F.lit(-1).alias("band")).distinct()
    sets = _sets(pairs.select("id").union(pairs.select(F.col("leader").alias("id"))), texts)
    return compare(left, right, sigs, sets, threshold)


def residual_links(members: DataFrame, roots: DataFrame, sigs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame | None:
    """Links (a, b) of one bucket and different components, at least one outside the leader's component and none the leader."""
    lead = roots.select(F.col("id").alias("leader"), F.col("root").alias("lead_root"))
    placed = members.filter("n > 2 and id <> leader").join(roots, "id", "left")
    placed = hot_join(materialise(placed.select("bucket", "band", "id", "size", "leader", F.coalesce("root", "id").alias("root")), "placed"), lead, ["leader"], "left")
    placed = materialise(placed.select("bucket", "band", "id", "size", F.xxhash64("root").alias("root"), (F.col("root") != F.coalesce("lead_root", "leader")).alias("rest")), "placed")
    if not placed.filter("rest").limit(1).count():
        return None
    parts = lambda rows, size: F.greatest(F.ceil(rows / BLOCK), F.ceil(size / BLOCK_BAGS), F.lit(1)).cast("int")
    is_rest = F.when(F.col("rest"), 1).otherwise(0)
    sizes = placed.groupBy("bucket").agg(F.sum(is_rest).alias("nr"), F.sum(is_rest * F.col("size")).alias("br"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bn"))
    sizes = materialise(sizes.filter("nr > 0").select("bucket", parts(F.col("nr"), F.col("br")).alias("rows"), parts(F.col("n"), F.col("bn")).alias("columns")), "sizes")
    placed = materialise(hot_join(placed, sizes, ["bucket"]), "placed")
    part = lambda n: F.pmod(F.xxhash64("id", F.lit("block")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["id", "root", "band"]
    left = placed.filter("rest").select("bucket", *keys, part("rows").alias("r"), every("columns").alias("c"))
    right = placed.select("bucket", *keys, every("rows").alias("r"), part("columns").alias("c"))
    group = F.xxhash64("bucket", "r", "c").alias("g")
    return compare(left.select(group, *keys), right.select(group, *keys), sigs, _sets(placed, texts), threshold)


def near_links(texts: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(links between different texts, links of copies to the text that stands for them), both (a, b), of (id, text)."""
    table = materialise(signature_table(texts), "signatures")
    first = table.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    standing = materialise(first.select("k1", "k2", "first", "n"), "first")
    copies = hot_join(table.select("id", "k1", "k2"), standing.filter("n > 1").select("k1", "k2", "first"), ["k1", "k2"])
    copies = materialise(copies.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")), "copies")
    sigs = materialise(table.join(standing.select(F.col("first").alias("id")), "id", "left_semi").select("id", "bands", "sig", "size").dropDuplicates(["id"]), "own")
    banded = materialise(band_keys(sigs), "banded")
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialise(hot_join(banded, materialise(sizes, "sizes"), ["bucket"]), "members")
    degree = members.groupBy("id").agg(F.sum("n").alias("degree"))
    leaders = members.join(degree, "id").groupBy("bucket").agg(F.min(F.struct((-F.col("degree")).alias("degree"), "id")).alias("l")).select("bucket", F.col("l.id").alias("leader"))
    members = materialise(hot_join(members, materialise(leaders, "leaders"), ["bucket"]), "led")
    links = materialise(star_links(members.filter("id <> leader").select("leader", "id").distinct(), sigs, texts, threshold), "links")
    more = residual_links(members, components(links), sigs, texts, threshold)
    if more is not None:
        links = materialise(links.union(more), "links")
    return links, copies


def near_classes(docs: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, root), both nodes, of every node that shares its class with another; root is the least node of the class."""
    links, copies = near_links(_texts(docs, id_col, text_col), threshold)
    return components(links.union(copies))


def near_dedup(docs: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id (the least id of its class) and kept (it stands for its class; of rows equal in id and text one does)."""
    roots = near_classes(docs, threshold=threshold, id_col=id_col, text_col=text_col)
    rows = docs.select(node(id_col, text_col).alias("id")).join(roots, "id", "left")
    turn = F.row_number().over(W.partitionBy("id").orderBy(F.lit(0)))
    root = F.coalesce("root", "id")
    return rows.select(F.col("id.i").alias(id_col), root["i"].alias("class_id"), (root.eqNullSafe(F.col("id")) & (turn == 1)).alias("kept"))
