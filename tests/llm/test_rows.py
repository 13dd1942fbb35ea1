"""Odd rows for every operator: nulls, empty and very long texts, ties, repeats, shared and textual ids, clashing columns, empty tables."""

import collections
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadloom.llm import language as L
from quadloom.llm.common import one_of_each, text_bytes
from quadloom.llm.decontaminate import contamination, without_matches
from quadloom.llm.line_dedup import dedup_lines
from quadloom.llm.media import decode, media_column
from quadloom.llm.near_dedup import near_dedup
from quadloom.llm.packing import pack_documents
from quadloom.llm.secrets import secret_spans
from quadloom.llm.sharding import Topology, assign, shard_documents
from tests.llm.test_operators import TONGUES, brute_classes, prose

CLASH = ["_k", "_t", "_lost", "_lines", "n_lines", "n_removed", "_key0", "_key1", "_same0", "id", "root", "sig", "score", "letters", "tokens", "chars", "tokenizer", "shard", "slot", "piece", "_bucket", "text_key", "kept", "class_id", "media"]
LINE = "a line of ten words that comes again and again "


def rows_of(spark, rows, kind="long"):
    """Documents with a column for each of the operators' own names."""
    return spark.createDataFrame([(*r, *["mine"] * len(CLASH)) for r in rows], f"doc_id {kind}, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH))


def odd(spark, kind="long"):
    r = random.Random(1)
    long_one = "\n".join(prose(r, TONGUES["en"], 12) for _ in range(2500))
    key = (lambda i: i) if kind == "long" else (lambda i: None if i is None else f"doc-{i}")
    texts = [(1, "one text that stands here twice or more"), (1, "one text that stands here twice or more"), (1, "another text with the same id as that"), (2, "one text that stands here twice or more"), (3, None), (None, None), (None, "no id here at all"), (None, "no id here at all"), (4, ""), (4, " \n\t "), (5, long_one), (6, LINE * 6 + "\n" + LINE * 6), (7, "x" * 200_000)]
    rows = [(key(i), t, "en" if t else None, "s", len(t or "")) for i, t in texts]
    return rows, rows_of(spark, rows, kind)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_every_row_has_its_result(spark, kind):
    rows, df = odd(spark, kind)
    bench = spark.createDataFrame([("b", "text that stands here twice or more"), (None, None)], "item_id string, text string")
    n = len(rows)
    ids = collections.Counter(r[0] for r in rows)
    for f in (secret_spans, media_column, lambda d: contamination(d, bench), lambda d: shard_documents(d, Topology.uniform(5)), L.identify_documents):
        assert collections.Counter(r["doc_id"] for r in f(df).collect()) == ids
        assert f(df.limit(0)).count() == 0
    pieces = pack_documents(df).collect()
    assert collections.Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == ids and pack_documents(df.limit(0)).count() == 0

    lines = dedup_lines(df).collect()
    assert len(lines) == n and all(r[c] == "mine" for r in lines for c in CLASH if c not in ("n_lines", "n_removed"))
    six = next(r for r in lines if r["doc_id"] in (6, "doc-6"))
    assert (six["n_lines"], six["n_removed"], six["text"]) == (2, 1, LINE * 6)
    assert dedup_lines(df.limit(0)).count() == 0

    clean = without_matches(df, bench).collect()
    assert len(clean) == n - 3 and all(r[c] == "mine" for r in clean for c in CLASH)
    for pass_bytes in (1, 1 << 20):
        assert sum(r["n_hit"] for r in contamination(df, bench, pass_bytes=pass_bytes).collect()) == 3 * 7

    classes = near_dedup(df).collect()
    assert collections.Counter(r["doc_id"] for r in classes) == ids
    kept = collections.Counter(r["doc_id"] for r in classes if r["kept"])
    one, two, four = (1, 2, 4) if kind == "long" else ("doc-1", "doc-2", "doc-4")
    assert kept[one] == 2 and kept[two] == 0 and kept[None] == 2 and kept[four] == 2
    assert {r["class_id"] for r in classes if r["doc_id"] == two} == {one}
    assert near_dedup(df.limit(0)).count() == 0


def test_stages_keep_columns_and_clean_rows(spark, tmp_path):
    rows, df = odd(spark)
    spark.createDataFrame([("b", "no item of this is there")], "item_id string, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, f"file://{tmp_path}")
        assert out.columns == df.columns, name
        got = out.collect()
        assert all(r[c] == "mine" for r in got for c in CLASH), name
        assert stage(spark, df.limit(0), f"file://{tmp_path}").count() == 0, name
        if name == "near_dedup":
            assert collections.Counter((r["doc_id"], r["text"]) for r in got) == {(i, t): 1 for i, t in {(r[0], r[1]) for r in rows} - {(2, rows[0][1])}}
    assert corpus_pipeline.STAGES[-1][1](spark, df.limit(0), f"file://{tmp_path}").count() == 0


def test_one_of_each(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, "a", "x"), (None, "a", "x"), (2, None, "x")], "i int, s string, _same0 string")
    assert sorted(map(tuple, one_of_each(df, [F.col("i"), F.col("s")]).collect()), key=str) == sorted([(1, "a", "x"), (None, "a", "x"), (2, None, "x")], key=str)


def test_near_duplicates_of_large_buckets_and_long_texts(spark):
    """Every class of brute force, among over 500 members that share bands and texts of over 512 shingles."""
    r = random.Random(3)
    base = [f"w{r.randint(0, 9999)}" for _ in range(700)]
    texts = []
    for k in range(560):  # copies at 0.6 to 1 of one text
        w = list(base[:120])
        for _ in range(r.choice([0, 1, 2, 3, 4])):
            w[r.randrange(120)] = f"v{k}x{r.random()}"
        texts.append(" ".join(w))
    for k in range(60):  # long ones around the threshold
        w = list(base)
        for _ in range(r.choice([2, 10, 14, 15, 16, 20])):
            w[r.randrange(700)] = f"z{k}x{r.random()}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x["doc_id"]: x["class_id"] for x in near_dedup(df).collect()}
    assert [found[i] for i in range(len(texts))] == brute_classes(texts)


def test_language_equals_the_formula(spark):
    """The posterior, computed again from its definition for every row."""
    r = random.Random(4)
    rows = []
    for i in range(120):
        tongue = r.choice(list(TONGUES))
        said = r.choice([tongue, tongue, f"{tongue.upper()}-XX", "fr", None, "enm", "xx"])
        rows.append((i, prose(r, TONGUES[tongue], r.choice([3, 10, 40])) if i % 11 else r.choice([None, "123", "Ж" * 40]), said, f"h{r.randint(0, 5)}.{r.choice(['de', 'com'])}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = [*L.LANGUAGES, L.UNKNOWN]
    model = L.fit(*L.sample(df, F.col("text"), F.col("lang"), F.col("doc_id")))
    raw, offs = text_bytes(pa.array([t or "" for _, t, _, _ in rows]))
    scores, letters = model.score(raw, offs)
    tag = lambda x: (x or "").split("-")[0].lower() if (x or "").split("-")[0].lower() in L.LANGUAGES else None
    best = [names[int(s.argmax())] if s.max() > 0 and n else L.UNKNOWN for s, n in zip(scores, letters, strict=True)]
    said = [tag(x) for _, _, x, _ in rows]
    hosts = [h for *_, h in rows]
    total = len(rows)
    share = {x: (sum(b == x for b, d in zip(best, said, strict=True)) + L.SMOOTH / 4) / (total + L.SMOOTH) for x in L.LANGUAGES}
    root = [(1 - L.UNKNOWN_PRIOR) * share[x] / sum(share.values()) for x in L.LANGUAGES] + [L.UNKNOWN_PRIOR]

    def smoothed(of, prior):
        counts = [sum(b == x for b, ok in zip(best, of, strict=True) if ok) for x in names]
        return [(c + L.SMOOTH * p) / (sum(counts) + L.SMOOTH) for c, p in zip(counts, prior, strict=True)]

    got = {x["doc_id"]: x for x in L.identify_documents(df).collect()}
    for k, (i, _, _, host) in enumerate(rows):
        level = smoothed([h.split(".")[-1] == host.split(".")[-1] for h in hosts], root)
        prior = smoothed([h == host for h in hosts], level)
        logs = []
        for j, x in enumerate(names):
            told = 0.0
            if said[k]:
                whole = sum(1 for b, d in zip(best, said, strict=True) if d and b == x)
                told = math.log((sum(1 for b, d in zip(best, said, strict=True) if d == said[k] and b == x) + L.DECLARED_SMOOTH) / (whole + L.DECLARED_SMOOTH * 4))
            logs.append((scores[k][j] if j < 4 else 0.0) + math.log(prior[j]) + told)
        p = np.exp(np.array(logs) - max(logs))
        x = got[i]
        if letters[k] == 0:
            assert (x["language"], x["probability"], x["kept"]) == (L.UNKNOWN, 1.0, False)
        else:
            assert x["language"] == names[int(p.argmax())] and x["probability"] == pytest.approx(p.max() / p.sum(), abs=1e-9), i
        assert x["declared"] == said[k] and x["text_language"] == best[k]


def test_shards_equal_the_draws(spark):
    """The descent, drawn again in Python."""
    tree = Topology.uniform(12, 3, 2).reweighted(4, 2.5).reweighted(7, 0.0)
    keys = [None, "", "a", *map(str, range(300))]
    got = {r["key"]: r["shard"] for r in assign(spark.createDataFrame([(k,) for k in keys], "key string"), tree, F.col("key")).collect()}

    def draw(*parts):
        return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:15], 16)

    def pick(key, level, parent, children):
        return min(children, key=lambda c: -math.log((draw(key, level, parent, c) + 0.5) / 2.0**60) / children[c])

    regions, racks, leaves = tree.children()
    for k in keys:
        text = "null key" if k is None else k
        region = pick(text, "region", "", regions)
        rack = f"{region}/{pick(text, 'rack', region, racks[region])}"
        assert got[k] == int(pick(text, "shard", rack, leaves[rack])), k


def test_stored_pcm_is_the_decoded_signal(spark):
    from quadloom.llm.media import CODECS, wave, read

    import zlib

    texts = ["", "short", "a longer text " * 40, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media_column(df, with_pcm=True).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        codec = CODECS[zlib.crc32(payload) % 3]
        pcm = decode([read(wave(payload, codec))])[0]
        assert bytes(r["pcm"]) == pcm.tobytes() and r["pcm_sha256"] == hashlib.sha256(pcm.tobytes()).hexdigest()
