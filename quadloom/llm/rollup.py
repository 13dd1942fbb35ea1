"""Token counts as delta-maintained rollups by source, language and tokenizer version.

Changes come in batches of signed rows: an insert adds a document's count, a delete takes it away, a revision takes the old
count away and adds the new one. A batch is reduced to one partial total per (source, language, version), written to a
folder of its own, and committed by a small file ``commits/<batch id>`` that names the folder and is created only if there
is none: of several writers of one batch one succeeds. So a batch may be sent again after a failure at any point, or twice
at once. Totals are the sums over the committed folders; as all measures are sums they don't depend on order. ``compact``
folds committed batches into a base, committed in the same way; commits stay, so that a folded batch can't come back.

State grows with groups times batches, never with documents. A group of any size is pre-aggregated where its rows are.

Null sources, languages or versions are groups of their own (null); null text has no tokens; a change of an unknown kind is
an error; rows that are equal are changes of their own; an empty batch commits and changes nothing; groups whose documents
have all gone keep no row. Columns besides the id, the text, source and lang aren't read.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialise
from .tokens import encoder, vocabulary_path

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")
STATE = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"
#: Words for the version of that name: runs of ASCII digits and letters and of other scripts' characters.
WORDS, WORD = "words", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _counted(docs: DataFrame, tokens, tokenizer: str, text_col: str, id_col: str) -> DataFrame:
    chars = F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("chars")
    return docs.select(F.col(id_col).alias("id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), tokens.alias("tokens"), chars, F.lit(tokenizer).alias("tokenizer"))


def count_words(docs: DataFrame, *, tokenizer: str = WORDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """As ``count_tokens``, by words; in the JVM alone."""
    return _counted(docs, F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long"), tokenizer, text_col, id_col)


def count_tokens(docs: DataFrame, *, tokenizer: str, vocabulary: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, source, lang, tokens, chars and tokenizer (the version's name) of each document."""
    path = vocabulary or vocabulary_path()
    names = ["id", "source", "lang", "tokens", "chars", "tokenizer"]

    def run(batches):
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            text = batch.column(3)
            tokens = pa.array([len(enc.ids(text[i].as_py())) for i in range(batch.num_rows)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), tokens, batch.column(4), batch.column(5)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(_counted(docs, F.col(text_col), tokenizer, text_col, id_col), run, f"id {kind}, source string, lang string, tokens long, chars long, tokenizer string")


def inserts(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.lit("insert").alias("op"), F.col("tokens"), F.col("chars"), F.lit(0).cast("long").alias("old_tokens"), F.lit(0).cast("long").alias("old_chars"))


def deletes(counted: DataFrame) -> DataFrame:
    return inserts(counted).withColumn("op", F.lit("delete"))


def revisions(counted: DataFrame, old_tokens, old_chars=None) -> DataFrame:
    """The counts of ``counted`` in place of older ones, which columns of it say."""
    return counted.select(*KEYS, F.lit("revise").alias("op"), "tokens", "chars", old_tokens.cast("long").alias("old_tokens"), (F.col("chars") if old_chars is None else old_chars).cast("long").alias("old_chars"))


def partial_totals(changes: DataFrame) -> DataFrame:
    """Signed sums of a batch: insert +, delete -, revise new - old."""
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null")))))
    signed = lambda new, old: F.sum(F.when(F.col("op") == "revise", F.col(new) - F.col(old)).otherwise(F.col(new) * sign))
    return changes.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("n_docs"), signed("tokens", "old_tokens").cast("long").alias("n_tokens"), signed("chars", "old_chars").cast("long").alias("n_chars"))


class TokenRollup:
    """A store of committed batches below ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _claim(self, name: str, text: str) -> bool:
        """Create a file if there is none: False if there was one."""
        from py4j.protocol import Py4JJavaError

        try:
            out = self._fs.create(self._at(name), False)
        except Py4JJavaError:
            if self._fs.exists(self._at(name)):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _base(self) -> tuple[int, dict]:
        """Number and content (folder, batches folded so far) of the newest base; -1 and nothing if there is none."""
        numbers = [int(n) for n in self._names("bases")]
        return (max(numbers), json.loads(self._read(f"bases/{max(numbers)}"))) if numbers else (-1, {"folder": None, "batches": []})

    def committed(self) -> list[str]:
        """The ids of all committed batches, folded or not."""
        return self._names("commits")

    def open_batches(self) -> list[str]:
        """The ids of the committed batches that no base has taken in."""
        folded = set(self._base()[1]["batches"])
        return [n for n in self.committed() if n not in folded]

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch once: False if it was there already."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch_id or ""):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if self._fs.exists(self._at(f"commits/{batch_id}")):
            return False
        folder = f"data/{uuid.uuid4().hex}"
        partial_totals(changes).write.parquet(f"{self.path}/{folder}")
        if self._claim(f"commits/{batch_id}", folder):
            return True
        self._fs.delete(self._at(folder), True)
        return False

    def _state(self, base: dict, batches: list[str]) -> DataFrame:
        folders = [f"{self.path}/{self._read(f'commits/{b}')}" for b in batches] + ([f"{self.path}/{base['folder']}"] if base["folder"] else [])
        if not folders:
            return self.spark.createDataFrame([], STATE)
        state = self.spark.read.schema(STATE).parquet(*folders)
        return state.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).filter("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_chars over all committed batches."""
        return self._state(self._base()[1], self.open_batches())

    def compact(self) -> bool:
        """Fold the committed batches into a new base, then drop what it replaces; a crash between leaves either state whole."""
        number, base = self._base()
        own = self.open_batches()
        if not own:
            return False
        folder = f"data/{uuid.uuid4().hex}"
        self._state(base, own).write.parquet(f"{self.path}/{folder}")
        if not self._claim(f"bases/{number + 1}", json.dumps({"folder": folder, "batches": sorted({*base["batches"], *own})})):
            self._fs.delete(self._at(folder), True)  # another writer was first
            return False
        for old in [self._read(f"commits/{b}") for b in own] + ([base["folder"]] if base["folder"] else []):
            self._fs.delete(self._at(old), True)
        return True


def maintain(store: TokenRollup, counted: DataFrame, withdrawn: DataFrame, loads: int = 4) -> DataFrame:
    """A store's life over a whole corpus: loads of provisional counts, their revision, a withdrawal; totals of what is left.

    ``counted`` (materialised; id and the rest) is inserted in ``loads`` batches with a provisional count, the characters by
    four; every batch is sent twice. After a compaction one batch revises the provisional counts to the tokens, a folded
    batch is sent once more, and the documents of ``withdrawn`` (column id) are deleted.
    """
    guess = F.floor(F.col("chars") / 4).cast("long")
    for k in range(loads):
        part = counted.filter(F.pmod(F.xxhash64("id", "chars"), F.lit(loads)) == k).withColumn("tokens", guess)
        store.commit(f"load-{k}", inserts(part))
        store.commit(f"load-{k}", inserts(part))
    store.compact()
    store.commit("recount", revisions(counted, guess))
    store.commit("load-0", inserts(counted))
    store.commit("withdrawal", deletes(counted.join(withdrawn.select("id").distinct(), "id", "left_semi")))
    return store.totals()


def rollup_documents(docs: DataFrame, withdrawn: DataFrame, path: str, *, vocabulary: str | None = None, versions: tuple[str, ...] = ("byte_bpe_50k", WORDS)) -> DataFrame:
    """Totals of ``docs`` without the documents ``withdrawn`` (column id) in every version, maintained by batches in a store at ``path``."""
    parts = [count_words(docs) if v == WORDS else count_tokens(docs, tokenizer=v, vocabulary=vocabulary) for v in versions]
    counted = parts[0]
    for p in parts[1:]:
        counted = counted.unionByName(p)
    return maintain(TokenRollup(docs.sparkSession, path), materialise(counted, "counted"), withdrawn)
