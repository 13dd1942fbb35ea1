"""Benchmark decontamination by suffix arrays over the training documents.

A shard is a block of whole documents. Its suffix array holds the word suffixes that start inside runs of test words
(others can't equal a test suffix), sorted to the depth of a window by prefix doubling. Every test suffix is binary-searched
in every shard, doubling level by level; its range of the suffix array gives all places where its window occurs. From
there the match is extended word by word against the test's own suffix array, by narrowing the interval of test suffixes
that still agree: the longest verbatim match and its location, without looking at pairs.

Shards are local to a task, so no document is shuffled. The test side is a stated query set. It goes to the executors in
passes of at most ``pass_bytes`` of item text: one pass's index at a time is made, broadcast, used by a scan of all
documents and given up; what the passes find (rows of documents that are hit alone) is written and joined. A benchmark
that fits one pass, the usual case, needs no join.

Words are runs of ASCII digits and letters (lower-cased) and non-ASCII characters, compared by 64-bit hashes. Null or empty
texts have no words; a text of any length is searched whole; items without words have no windows; items with one id count
once; null item ids count as ""; rows equal in id and text have equal results, rows that share an id only are told apart by
their texts; an empty table of documents gives no rows, an empty benchmark no hits. ``contamination`` reads no other
columns, ``without_matches`` carries them along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, blocks, fresh, materialise, scan_words, text_bytes

WINDOW = 8
PASS_BYTES = 64 << 20


def _pair(rank: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    return (rank[at].astype(np.int64) << 32) | rank[at + step]


def _covers(n: int) -> int:
    """The doubling level whose length is the largest power of two not over ``n``."""
    return n.bit_length() - 1


class TestIndex:
    """The test suffixes: word numbers, their own suffix array, and the windows with their items."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        import pyarrow as pa

        items = [(i if i is not None else "", t or "") for i, t in items]
        raw, offs = text_bytes(pa.array([t for _, t in items], pa.large_string()))
        hashes, _, _, first = scan_words(raw, offs)
        self.window = window
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        n_words = np.diff(first)
        # word numbers from 1, a zero behind each item, and zeros to look ahead into
        self.words = np.zeros(len(hashes) + len(items) + 2 * window, np.int64)
        item_of_word = np.repeat(np.arange(len(items)), n_words)
        self.words[np.arange(len(hashes)) + item_of_word] = number.reshape(-1) + 1
        start = first[:-1] + np.arange(len(items))
        ids, item_id = np.unique(np.array([i for i, _ in items], object).astype(str), return_inverse=True) if items else (np.zeros(0, str), np.zeros(0, int))
        self.ids = ids.tolist()
        # distinct windows (start, length, item): of ``window`` words, or a shorter item whole
        at, length, owner = [], [], []
        for k, n in enumerate(n_words.tolist()):
            if n:
                m = max(1, n - window + 1)
                at.append(start[k] + np.arange(m))
                length.append(np.full(m, min(n, window)))
                owner.append(np.full(m, item_id.reshape(-1)[k]))
        self.at, self.length, self.owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, length, owner))
        # windows equal in text belong to every item that has them
        same: dict[bytes, set[int]] = {}
        keys = [self.words[a : a + m].tobytes() for a, m in zip(self.at.tolist(), self.length.tolist(), strict=True)]
        for key, i in zip(keys, self.owner.tolist(), strict=True):
            same.setdefault(key, set()).add(i)
        self.owners = [same[key] for key in keys]
        self.item_at = np.repeat(item_id.reshape(-1), n_words + 1) if items else np.zeros(0, np.int64)
        self._sort()

    def _sort(self) -> None:
        """The test's suffix array (suffixes end with their item), by prefix doubling."""
        words = self.words
        at = np.flatnonzero(words)
        rank, step = words.copy(), 1
        while len(at) and step < len(words):
            ahead = np.minimum(at + step, len(words) - 1)
            key, new = np.unique((rank[at] << 32) | rank[ahead], return_inverse=True)
            rank = rank.copy()
            rank[at] = new.reshape(-1) + 1
            if len(key) == len(at):
                break
            step *= 2
        self.order = at[np.argsort(rank[at], kind="stable")] if len(at) else at
        self.place = np.zeros(len(words), np.int64)
        self.place[self.order] = np.arange(len(self.order))

    def __len__(self) -> int:
        return len(self.at)

    def longest(self, words: np.ndarray, at: np.ndarray, test_at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches of ``words[at:]`` in the test, given that ``depth`` words agree with ``test_at``: (length, a place in the test)."""
        order, own, n = self.order, self.words, len(self.order)

        def bound(lo, hi, offset, value, right):
            lo, hi = lo.copy(), hi.copy()
            while True:
                open_ = lo < hi
                if not open_.any():
                    return lo
                mid = (lo + hi) >> 1
                w = own[np.minimum(order[np.minimum(mid, n - 1)] + offset, len(own) - 1)]
                less = (w <= value if right else w < value) & open_
                lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)

        # the interval of test suffixes that agree in the first words
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), n, np.int64)
        best, where = np.zeros(len(at), np.int64), test_at.copy()
        live, step = np.arange(len(at)), 0
        while len(live):
            value = words[np.minimum(at[live] + step, len(words) - 1)]
            a, b = bound(lo[live], hi[live], step, value, False), bound(lo[live], hi[live], step, value, True)
            keep = (value > 0) & (a < b)
            live, a, b = live[keep], a[keep], b[keep]
            lo[live], hi[live] = a, b
            step += 1
            best[live], where[live] = step, order[a]
        return best, where


def shard_hits(words: np.ndarray, index: TestIndex) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(places in ``words``, number of the test window there, its length): the shard's suffix array, searched for every test suffix.

    ``words`` holds test word numbers, 0 for other words and behind each document, and ends with a window of zeros.
    """
    if not len(index):
        return
    lengths = sorted(set(index.length.tolist()))
    rank = words.copy()
    present = np.zeros(len(index.vocabulary) + 1, bool)
    present[words] = True
    test = np.where(present[index.words], index.words, 0)  # a suffix whose first word isn't here ends at once
    if not test.any():
        return
    step, level = 1, 0
    at, test_at = np.flatnonzero(rank), np.flatnonzero(test)
    while True:
        for n in (x for x in lengths if _covers(x) == level):
            # windows of n words: two overlapping spans of this level, or one
            own, shift = np.flatnonzero(index.length == n), n - step
            q = index.at[own]
            ok = (test[q] > 0) & (test[q + shift] > 0)
            own, q = own[ok], q[ok]
            p = at[rank[at + shift] > 0] if shift else at
            if len(p) and len(q):
                key = _pair(rank, p, shift)
                order = np.argsort(key, kind="stable")  # the suffix array to depth n
                key, p = key[order], p[order]
                wanted, first = np.unique(_pair(test, q, shift), return_index=True)
                low, high = np.searchsorted(key, wanted), np.searchsorted(key, wanted, side="right")
                count = high - low
                total = int(count.sum())
                if total:
                    begin = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
                    yield p[np.arange(total) + begin], np.repeat(own[first], count), n
        if step * 2 > max(lengths) or not len(at):
            return
        at = at[rank[at + step] > 0]
        test_at = test_at[test[test_at + step] > 0]
        key, dense = np.unique(_pair(rank, at, step), return_inverse=True)
        wanted = _pair(test, test_at, step)
        found = np.searchsorted(key, wanted)
        hit = found < len(key)
        hit[hit] = key[found[hit]] == wanted[hit]
        rank, test = np.zeros_like(rank), np.zeros_like(test)
        rank[at] = dense.reshape(-1) + 1
        test[test_at] = np.where(hit, found + 1, 0)
        test_at = test_at[hit]
        step, level = step * 2, level + 1


def scan_block(raw: np.ndarray, offs: np.ndarray, index: TestIndex):
    """Of a block of texts: words per text, hit intervals [(start, end)], item ids and (longest, item, start) of each."""
    hashes, _, _, first = scan_words(raw, offs)
    n = len(offs) - 1
    n_words = np.diff(first)
    found = np.searchsorted(index.vocabulary, hashes)
    known = found < len(index.vocabulary)
    known[known] = index.vocabulary[found[known]] == hashes[known]
    words = np.zeros(len(hashes) + n + 2 * index.window, np.int64)
    doc = np.repeat(np.arange(n), n_words)
    words[np.arange(len(hashes)) + doc] = np.where(known, found + 1, 0)
    begin = first[:-1] + np.arange(n)
    runs: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[list[str]] = [[] for _ in range(n)]
    best: list[tuple[int, str | None, int]] = [(0, None, 0)] * n
    hits = list(shard_hits(words, index))
    if not hits:
        return n_words, runs, items, best
    at, window, length = (np.concatenate(x) for x in zip(*((a, w, np.full(len(a), m)) for a, w, m in hits), strict=True))
    of = np.searchsorted(begin, at, side="right") - 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    covered = np.cumsum(edge[:-1]) > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    for a, b in turn.reshape(-1, 2).tolist():
        d = int(np.searchsorted(begin, a, side="right")) - 1
        runs[d].append((a - int(begin[d]), b - int(begin[d])))
    for d, w in np.unique(np.column_stack([of, window]), axis=0).tolist():
        items[d].extend(index.owners[w])
    items = [sorted({index.ids[i] for i in x}) for x in items]
    size, where = index.longest(words, at, index.at[window], length)
    for k in np.lexsort((at, -size))[::-1].tolist():  # the longest, then the earliest, is set last
        best[int(of[k])] = (int(size[k]), index.ids[int(index.item_at[where[k]])], int(at[k] - begin[of[k]]))
    return n_words, runs, items, best


def _passes(benchmark: DataFrame, id_col: str, text_col: str, pass_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in lists of at most ``pass_bytes`` of text (a larger one stands alone); one list at a time is held."""
    own, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        n = 4 * len(r["t"] or "")
        if own and size + n > pass_bytes:
            yield own
            own, size = [], 0
        own.append((r["i"], r["t"]))
        size += n
    yield own


_FOUND = "n_words long, runs array<struct<a:int,b:int>>, items array<string>, longest_match long, match_item string, match_start long"


def _scan(docs: DataFrame, index, keys: list[str], text_col: str, only_hits: bool) -> DataFrame:
    """The columns ``keys`` of every document (or of those that are hit) and what one pass finds in it."""
    names = [*keys, "n_words", "runs", "items", "longest_match", "match_item", "match_start"]

    def run(batches):
        import pyarrow as pa

        kinds = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            raw, offs = text_bytes(batch.column(len(keys)))
            for rows in blocks(np.diff(offs)):
                own = offs[rows.start : rows.stop + 1]
                n_words, runs, items, best = scan_block(raw[own[0] : own[-1]], own - own[0], index.value)
                pick = [i for i, x in enumerate(items) if x or not only_hits]
                of = lambda column: column.slice(rows.start, rows.stop - rows.start).take(pa.array(pick, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(of(batch.column(k)) for k in range(len(keys))), pa.array(n_words[pick].astype(np.int64)), pa.array([[{"a": a, "b": b} for a, b in runs[i]] for i in pick], kinds),
                        pa.array([items[i] for i in pick], pa.list_(pa.string())), *(pa.array([best[i][k] for i in pick], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))),
                    ],
                    names=names,
                )

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return arrow_map(docs.select(*keys, text_col), run, f"{kinds}, {_FOUND}")


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, least_items: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, match_item, match_start (in words)."""
    context = docs.sparkSession.sparkContext
    passes = _passes(benchmark, item_col, item_text_col, pass_bytes)
    items, following = next(passes), next(passes, None)
    if following is None:
        found = _scan(docs, context.broadcast(TestIndex(items, window)), [id_col], text_col, False)
        hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]))  # runs of one pass don't overlap
    else:
        text_key, none = fresh(docs.select(id_col, text_col), "text_key")[0], TestIndex([], window)
        keyed = docs.select(id_col, text_col, F.xxhash64(text_col).alias(text_key))
        parts = []
        while items is not None:
            index = context.broadcast(TestIndex(items, window))
            parts.append(materialise(_scan(keyed, index, [id_col, text_key], text_col, True).dropDuplicates([id_col, text_key]), "hits"))
            index.destroy()
            items, following = following, next(passes, None)
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.unionByName(p)
        best = F.max(F.struct("longest_match", F.struct((-F.col("match_start")).alias("s"), "match_item", "match_start").alias("m"))).alias("best")
        hits = hits.groupBy(id_col, text_key).agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), best)
        hits = hits.select(F.col(id_col).alias("hit_id"), F.col(text_key).alias("hit_key"), "runs", "items", "best")
        every = _scan(keyed, context.broadcast(none), [id_col, text_key], text_col, False).select(id_col, text_key, "n_words")
        joined = every.join(hits, F.col(id_col).eqNullSafe(F.col("hit_id")) & (F.col(text_key) == F.col("hit_key")), "left")
        empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
        found = joined.select(
            id_col, "n_words", empty("runs", "array<struct<a:int,b:int>>"), empty("items", "array<string>"),
            F.coalesce("best.longest_match", F.lit(0)).cast("long").alias("longest_match"), F.col("best.m.match_item").alias("match_item"), F.coalesce("best.m.match_start", F.lit(0)).cast("long").alias("match_start"),
        )
        hit = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda x: F.sequence(x["a"], x["b"] - 1))))).cast("long")
    n_items = F.size("items").cast("long")
    return found.select(
        id_col, "n_words", hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_items >= least_items).alias("contaminated"), "longest_match", "match_item", "match_start",
    )


def without_matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no test window (nor a shorter item whole): removed where they are found, nothing is joined.

    With several passes each one's remainder but the last is written, so that one index at a time is alive.
    """
    at = docs.columns.index(text_col)

    def clean(rows_in: DataFrame, index) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                raw, offs = text_bytes(batch.column(at))
                for rows in blocks(np.diff(offs)):
                    own = offs[rows.start : rows.stop + 1]
                    found = scan_block(raw[own[0] : own[-1]], own - own[0], index.value)[2]
                    yield batch.slice(rows.start, rows.stop - rows.start).filter(pa.array([not x for x in found], pa.bool_()))

        return arrow_map(rows_in, run, docs.schema)

    passes = _passes(benchmark, item_col, item_text_col, pass_bytes)
    items, following = next(passes), next(passes, None)
    while following is not None:
        index = docs.sparkSession.sparkContext.broadcast(TestIndex(items, window))
        docs = materialise(clean(docs, index), "clean")
        index.destroy()
        items, following = following, next(passes, None)
    return clean(docs, docs.sparkSession.sparkContext.broadcast(TestIndex(items, window)))
