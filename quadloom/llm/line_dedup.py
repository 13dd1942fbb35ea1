"""Line dedup by winnowing over line hashes, in DataFrame operations only.

The tokens are the non-blank lines of a document. A window is a shortest run of lines of at least ``min_words`` words: one
starts at every line that has that many words from there on, and one ends at every line that has them up to there. Its
minimum in the order (most words first, then hash) is its fingerprint. Window and fingerprint depend on content alone, so
every copy of a repeated run has the same windows with the same fingerprints.

Windows are looked up by their fingerprint and the hash of all their lines, so two meet only if they are equal as a whole;
all but the first occurrence in the corpus (by id, then place) are deleted. This is exact: the windows inside a repeated run
of at least ``min_words`` words cover it (a line lies in the window that starts at it, in the one that ends at it, or else
in the one that starts with the run), and each of them is such a run itself. A window that ends at a line and is also the
one that starts at its first line is looked up once.

All steps are linear in the lines: there are at most two windows a line, and each is compared with the first of its key,
never with all copies. Only hashes, places and counts are shuffled, and the texts once, to drop the lines.

Words are runs of characters that are neither blanks nor tabs, line ends, no-break or ideographic spaces; a line without
words is blank. Null text: the row stays, with null text. Null id: the text's hash stands for it. Ids that aren't whole
numbers are ordered as strings. Rows with equal id and text are one document. Blank lines are kept and never counted. A
document all of whose lines are deleted gets an empty text. Columns besides id and text pass through, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, hot_join, materialise, string_hash

MIN_WORDS = 50
WORD = "[^ \\t\\r\\n\\f\u000b\u00a0\u3000]+"


def _keys(docs: DataFrame, text_col: str, id_col: str) -> tuple[Column, Column]:
    """Place in the order of documents, never null, and the text's hash."""
    th = F.xxhash64(F.col(text_col))
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        return F.coalesce(F.col(id_col).cast("long"), th), th
    return F.coalesce(F.col(id_col).cast("string"), th.cast("string")), th


def line_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k, t (the document), pos (place among all lines), h (hash), nw (words), c (words before it), e (words up to its end), total."""
    k, t = _keys(docs, text_col, id_col)
    lines = docs.filter(F.col(text_col).isNotNull()).select(k.alias("k"), t.alias("t"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    lines = lines.select("k", "t", "pos", string_hash(F.col("line")).alias("h"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("nw")).filter("nw > 0")
    by_doc = W.partitionBy("k", "t")
    e = F.sum("nw").over(by_doc.orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    return lines.repartition("k", "t").dropDuplicates(["k", "t", "pos"]).select("k", "t", "pos", "h", "nw", (e - F.col("nw")).alias("c"), e.alias("e"), F.sum("nw").over(by_doc).alias("total"))


def windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """mark (the fingerprint's hash), key (the hash of all lines), k, t, pos (of the line it starts or ends at), places (of its lines)."""
    ahead = W.partitionBy("k", "t").orderBy("c").rangeBetween(0, min_words - 1)
    behind = W.partitionBy("k", "t").orderBy("e").rangeBetween(1 - min_words, 0)
    run = F.collect_list(F.struct((-F.col("nw")).alias("nw"), "h", "pos"))
    both = lines.select("k", "t", "pos", "nw", "c", "e", "total", run.over(ahead).alias("ahead"), run.over(behind).alias("behind"), F.min("c").over(behind).alias("from"))
    one = F.explode(
        F.array_compact(
            F.array(
                F.when(F.col("total") - F.col("c") >= min_words, F.col("ahead")),
                F.when(F.col("e") - F.col("from") - F.col("nw") >= min_words, F.col("behind")),  # else it starts a window of its first line
            )
        )
    )
    return both.select("k", "t", "pos", one.alias("x")).select(F.array_min("x")["h"].alias("mark"), F.xxhash64("x.h").alias("key"), "k", "t", "pos", F.col("x.pos").alias("places"))


def repeated_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines to delete: (k, t, pos), each once."""
    found = materialise(windows(line_table(docs, id_col=id_col, text_col=text_col), min_words), "windows")
    first = materialise(found.groupBy("mark", "key").agg(F.min(F.struct("k", "t", "pos")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    later = hot_join(found, first.select("mark", "key", "f"), ["mark", "key"], counts=first).filter("struct(k, t, pos) <> f")
    return later.select("k", "t", F.explode("places").alias("pos")).distinct()


def dedup_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The rows of ``docs`` without the later repeated runs, and how many lines each had and lost; columns named like ``counts`` are replaced."""
    k, t = _keys(docs, text_col, id_col)
    own_k, own_t, lost, lines = fresh(docs, "_k", "_t", "_lost", "_lines")
    dead = repeated_lines(docs, min_words=min_words, id_col=id_col, text_col=text_col).groupBy("k", "t").agg(F.collect_list("pos").alias("dead")).toDF(own_k, own_t, lost)
    split = F.split(F.col(text_col), "\n", -1)
    live = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
    rest = F.array_join(F.transform(live, lambda i: F.get(F.col(lines), i)), "\n")
    keyed = docs.withColumns({own_k: k, own_t: t}).join(dead, [own_k, own_t], "left").withColumn(lines, split)
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    kept = [F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(rest).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in counts]
    return keyed.select(*kept, size(lines).alias(counts[0]), size(lost).alias(counts[1]))
