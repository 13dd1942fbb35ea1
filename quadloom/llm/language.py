"""Language identification by Bayesian evidence fusion.

For each document the posterior over languages, and over "und" for text of none of them, is the product of
 - the text's likelihood: naive Bayes over hashed byte trigrams of the whole text, fitted on at most ``sample_docs`` rows
   and ``sample_bytes`` of text that declare a language (chosen by the hash of their id and text, whole texts; relabelled by the model and fitted once more, so
   wrong declarations don't stick); "und" is the uniform model;
 - the declared language: how often texts of a language declare it, counted over all documents;
 - the address: a prior for the host, smoothed towards its suffix's, which is smoothed towards the corpus's; all three are
   grouped counts over all documents.
Rows are scored once; only ids, hosts and scores are joined with the priors, never texts. Hot hosts are counted where they
are first and have one prior row each.

Defined results: null or letterless text has no text evidence and is rejected as "und"; a null or unknown declaration or
host is no evidence beyond the next level's; equal rows get equal results, rows that share an id are judged each on its
own; texts of any length are scored whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, blocks, hot_join, materialise, text_bytes

BUCKETS = 1 << 16
LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 16 << 20
#: Strength of the next level's prior, in documents, and of a count in the table of declarations.
SMOOTH, DECLARED_SMOOTH = 20.0, 1.0
#: Prior share of "und".
UNKNOWN_PRIOR = 0.01
#: Trigrams overlap: three of them are one observation.
OVERLAP = 3.0

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[[9, 10, 11, 12, 13]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[192:] = True


def trigrams(raw: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that begins at each byte but the last two."""
    s = _FOLD[raw]
    return (s[:-2] * np.uint32(40503) + s[1:-1] * np.uint32(2699) + s[2:] * np.uint32(61)) & np.uint32(BUCKETS - 1)


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    table: np.ndarray  # BUCKETS x languages: log-likelihoods

    def score(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text in each language (n, L) less that of the uniform model, and its number of letters."""
        n = len(offs) - 1
        letters = np.diff(np.concatenate([[0], np.cumsum(_LETTER[raw])])[offs])
        out = np.zeros((n, len(self.languages)))
        if len(raw) > 2:
            tri = trigrams(raw)
            a, b = np.minimum(offs[:-1], len(tri)), np.minimum(np.maximum(offs[1:] - 2, offs[:-1]), len(tri))
            for k in range(len(self.languages)):
                total = np.concatenate([[0.0], np.cumsum(self.table[:, k].astype(np.float64)[tri])])
                out[:, k] = total[b] - total[a]
        return out / OVERLAP, letters


def fit(texts: list[str], declared: list[str], languages: tuple[str, ...] = LANGUAGES, rounds: int = 2) -> TextModel:
    """Counts of trigrams by language with half a count added; each round relabels the sample by the model before."""
    import pyarrow as pa

    index = {x: i for i, x in enumerate(languages)}
    label = np.array([index.get(d, -1) for d in declared], np.int64)
    raw, offs = text_bytes(pa.array(texts, pa.large_string()))
    model = None
    for _ in range(rounds):
        counts = np.full((BUCKETS, len(languages)), 0.5)
        for i, k in enumerate(label.tolist()):
            own = raw[offs[i] : offs[i + 1]]
            if k >= 0 and len(own) > 2:
                counts[:, k] += np.bincount(trigrams(own), minlength=BUCKETS)
        # relative to the uniform model
        model = TextModel(languages, (np.log(counts / counts.sum(0)) + np.log(BUCKETS)).astype(np.float32))
        best = [np.zeros((0, len(languages)))]
        for rows in blocks(np.diff(offs)):
            own = offs[rows.start : rows.stop + 1]
            best.append(model.score(raw[own[0] : own[-1]], own - own[0])[0])
        scores = np.concatenate(best)
        label = np.where(scores.max(1, initial=-np.inf) > 0, scores.argmax(1), -1)
    return model


def spoken(declared: Column) -> Column:
    """The language of a declared tag: its first part, in small letters (``en`` of ``EN-us``; ``enm`` is a language of its own)."""
    return F.regexp_extract(F.lower(F.trim(declared.cast("string"))), "^([a-z]+)(?:[-_].*)?$", 1)


def sample(
    docs: DataFrame, text: Column, declared: Column, key: Column, sample_docs: int = SAMPLE_DOCS, languages: tuple[str, ...] = LANGUAGES, sample_bytes: int = SAMPLE_BYTES
) -> tuple[list[str], list[str]]:
    """Texts and declarations of at most ``sample_docs`` rows and ``sample_bytes`` of text, in equal shares by language: those of the least hash of key and text whose texts fit in."""
    each, share = max(1, sample_docs // len(languages)), sample_bytes // len(languages)
    rows = docs.select(text.alias("t"), spoken(declared).alias("d"), F.xxhash64(key, text).alias("h"))
    sized = rows.select("h", "d", F.octet_length("t").alias("b")).filter(F.col("b") <= share)
    chosen = set()
    for x in languages:
        left = share
        for r in sized.filter(F.col("d") == x).groupBy("h").agg(F.max("b").alias("b")).orderBy("h").limit(each).collect():
            if r["b"] <= left:
                left -= r["b"]
                chosen.add(r["h"])
    small = docs.sparkSession.createDataFrame([(h,) for h in sorted(chosen)], "h long")  # at most sample_docs rows
    got = rows.join(F.broadcast(small), "h", "left_semi").dropDuplicates(["h"]).select("t", "d", "h").collect()
    return [r["t"] or "" for r in sorted(got, key=lambda r: r["h"])], [r["d"] or "" for r in sorted(got, key=lambda r: r["h"])]


def score_text(docs: DataFrame, model: TextModel, columns: dict[str, Column], text: Column) -> DataFrame:
    """``columns`` and: score (array), letters, text_language (the best of the languages and "und")."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, offs = text_bytes(batch.column(batch.num_columns - 1))
            for rows in blocks(np.diff(offs)):
                own = offs[rows.start : rows.stop + 1]
                score, letters = model.score(raw[own[0] : own[-1]], own - own[0])
                n = rows.stop - rows.start
                best = score.argmax(1)
                name = [model.languages[k] if s > 0 and m else UNKNOWN for k, s, m in zip(best.tolist(), score.max(1).tolist(), letters.tolist(), strict=True)]
                flat = pa.array(score.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * score.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(rows.start, n) for i in range(batch.num_columns - 1)), lists, pa.array(letters.astype(np.int64)), pa.array(name, pa.string())], names=names)

    rows = docs.select(*[c.alias(k) for k, c in columns.items()], text.alias("_text"))
    names = [*columns, "score", "letters", "text_language"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return arrow_map(rows, run, f"{schema}, score array<double>, letters long, text_language string")


def identify(
    docs: DataFrame, *, text: Column, declared: Column, host: Column, suffix: Column, keys: dict[str, Column], languages: tuple[str, ...] = LANGUAGES, sample_docs: int = SAMPLE_DOCS, least: float = 0.5
) -> DataFrame:
    """One row per document: ``keys``, language, probability, text_language, declared, kept (a language of ``languages`` of at least ``least``)."""
    names = (*languages, UNKNOWN)
    model = fit(*sample(docs, text, declared, next(iter(keys.values())), sample_docs, languages), languages)
    said_so = spoken(declared)
    evidence = {**keys, "_declared": F.when(said_so.isin(*languages), said_so), "_host": F.coalesce(host.cast("string"), F.lit("")), "_suffix": F.coalesce(suffix.cast("string"), F.lit(""))}
    scored = materialise(score_text(docs, model, evidence, text), "language")

    # counts over all documents: at most languages x languages numbers, then suffixes, then hosts
    cells = {(r["_declared"], r["text_language"]): r["n"] for r in scored.groupBy("_declared", "text_language").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(cells.values())
    share = {x: (sum(n for (_, t), n in cells.items() if t == x) + SMOOTH / len(languages)) / (total + SMOOTH) for x in languages}
    root = [(1 - UNKNOWN_PRIOR) * share[x] / sum(share.values()) for x in languages] + [UNKNOWN_PRIOR]
    said = {}
    for d in languages:
        for k, x in enumerate(names):
            whole = sum(cells.get((e, x), 0) for e in languages)
            said[d, k] = float(np.log((cells.get((d, x), 0) + DECLARED_SMOOTH) / (whole + DECLARED_SMOOTH * len(languages))))
    counts = [F.count(F.when(F.col("text_language") == x, 1)).cast("double") for x in names]
    host_counts = scored.groupBy("_suffix", "_host").agg(F.array(*counts).alias("_nh"))
    by_suffix = host_counts.groupBy("_suffix").agg(F.array(*[F.sum(F.col("_nh")[k]) for k in range(len(names))]).alias("_ns"))
    smoothed = lambda n, prior: F.array(*[(n[k] + SMOOTH * prior[k]) / (sum((n[j] for j in range(len(names))), F.lit(0.0)) + SMOOTH) for k in range(len(names))])
    level = by_suffix.select("_suffix", smoothed(F.col("_ns"), [F.lit(x) for x in root]).alias("_ps"))
    priors = host_counts.join(level, "_suffix").select("_suffix", "_host", smoothed(F.col("_nh"), F.col("_ps")).alias("_prior"))

    # a hot host's rows stay where they are
    fused = hot_join(scored, materialise(priors, "priors"), ["_suffix", "_host"])
    told = F.create_map(*[v for d in languages for v in (F.lit(d), F.array(*[F.lit(said[d, k]) for k in range(len(names))]))])
    logs = F.array(*[
        (F.col("score")[k] if k < len(languages) else F.lit(0.0)) + F.ln(F.col("_prior")[k]) + F.when(F.col("_declared").isNull(), 0.0).otherwise(F.element_at(told, F.coalesce("_declared", F.lit(languages[0])))[k]) for k in range(len(names))
    ])
    ranked = fused.withColumn("_logs", logs).withColumn("_top", F.array_max("_logs"))
    best = F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position(F.col("_logs"), F.col("_top")).cast("int"))
    language = F.when(F.col("letters") == 0, UNKNOWN).otherwise(best)
    probability = 1 / F.aggregate(F.col("_logs"), F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_top")))
    return ranked.select(*keys, language.alias("language"), F.when(F.col("letters") == 0, 1.0).otherwise(probability).alias("probability"), "text_language", F.col("_declared").alias("declared")).withColumn(
        "kept", (F.col("language") != UNKNOWN) & (F.col("probability") >= least)
    )


def identify_documents(docs: DataFrame, keys: dict[str, Column] | None = None, **options) -> DataFrame:
    """``documents``: the column lang is the declaration, source the host (its part behind the last dot the suffix)."""
    source = F.col("source").cast("string")
    return identify(docs, text=F.col("text"), declared=F.col("lang"), host=source, suffix=F.when(source.contains("."), F.substring_index(source, ".", -1)), keys=keys or {"doc_id": F.col("doc_id")}, **options)


def identify_pages(pages: DataFrame, **options) -> DataFrame:
    """``pages``: the markup's lang attribute is the declaration, the url gives host and suffix; tags, scripts and styles are no text."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), "<[^>]*>", " ")
    declared = F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", 1)
    return identify(pages, text=text, declared=declared, host=host, suffix=F.substring_index(host, ".", -1), keys={"page_id": F.col("page_id"), "url": F.col("url")}, **options)
