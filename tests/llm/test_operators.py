"""The ten operators against brute force, exact round trips or held-out accuracy, with nulls, ties, repeats and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadloom.llm.automaton import scan
from quadloom.llm.bagminhash import compact, overlaps, shingles, signatures
from quadloom.llm.common import text_bytes
from quadloom.llm.components import components
from quadloom.llm.decontaminate import contamination, without_matches
from quadloom.llm.language import fit, identify_documents, identify_pages
from quadloom.llm.line_dedup import dedup_lines
from quadloom.llm.media import CODECS, TABLES, media_column, read, resample, wave
from quadloom.llm.near_dedup import near_dedup
from quadloom.llm.packing import SpaceTree, cut, pack_documents, plan
from quadloom.llm.rollup import TokenRollup, count_tokens, deletes, inserts, revisions, rollup_documents
from quadloom.llm.secrets import RULES, find, joined, scanner, secret_spans
from quadloom.llm.sharding import Topology, shard_documents
from quadloom.llm.tokens import encoder, vocabulary_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, k string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def docs(spark, texts, ids=None):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", f"s{i % 3}", len(t or ""), "x", "y") for i, t in enumerate(texts)], SCHEMA)


ODD = [None, "", " ", "\n\n", "same text here again", "same text here again", "é" * 500, "word " * 3000]


# 1 packing


def test_tree_finds_the_tightest():
    r = random.Random(1)
    for _ in range(50):
        t, own = SpaceTree(40), {x for x in range(41) if r.random() < 0.2}
        for x in own:
            t.set(x, True)
        for need in range(41):
            assert t.tightest(need) == min((x for x in own if x >= need), default=None)


def best_fit(lengths, cap):
    """Spaces left by best fit run piece by piece."""
    import bisect

    bins = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(bins, n)
        bisect.insort(bins, (bins.pop(i) if i < len(bins) else cap) - n)
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    r = random.Random(2)
    cases = [(20, [2] * 31 + [8] * 10 + [7] * 33 + [4] * 5 + [3] * 12), (1024, [600] * 10 + [100] * 10)]
    for _ in range(3000):
        cap = r.choice([8, 16, 20, 64, 100, 1024])
        few = [x for x in (r.randint(1, cap) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 40))]
        cases.append((cap, few if r.random() < 0.7 else [r.randint(1, cap) for _ in range(r.randint(0, 150))]))
    for cap, lengths in cases:
        filled, ranks = collections.defaultdict(list), collections.defaultdict(list)
        for length, rank, n, first, offset in plan(dict(collections.Counter(lengths)), cap).tolist():
            for k in range(n):
                filled[first + k].append((offset, length))
                ranks[length].append(rank + k)
        for pieces in filled.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
        assert {n: sorted(x) for n, x in ranks.items()} == {n: list(range(m)) for n, m in collections.Counter(lengths).items()}
        assert sorted(cap - sum(n for _, n in x) for x in filled.values()) == best_fit(lengths, cap), (cap, lengths)


def test_ids_equal_the_tokenizers_librarys():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own, r = encoder(vocabulary_path()), random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "word", "'s", "'", "12", "é", "日本", "😀", "\u00a0", "\u3000", " \n", "...", "<|endoftext|>", "don't", "\r\n", "_", "½"]
    for _ in range(500):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert own.ids(t).tolist() == exact.encode(t, add_special_tokens=False).ids, repr(t)


def test_added_tokens_have_their_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    exact, r = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(18)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", " word", "'s", "12", "é", "日本", "<", "don't"]
    texts = ["", "<|endoftext|>", "a <|endoftext|> b", *("".join(r.choice(parts) for _ in range(r.randint(0, 15))) for _ in range(300)), "x <|endoftext|>" * 700]
    ids = [exact.encode(t, add_special_tokens=False).ids for t in texts]
    own = encoder(vocabulary_path())
    for t, x in zip(texts, ids, strict=True):
        assert own.ids(t).tolist() == x, repr(t)
    assert ids[2] == [64, 220, 50256, 275]
    df = docs(spark, texts)
    pieces = collections.defaultdict(list)
    for x in pack_documents(df).collect():
        pieces[x["doc_id"]].append((x["start"], x["length"], x["ids_crc32"]))
    counts = {x["id"]: x["tokens"] for x in count_tokens(df, tokenizer="v1").collect()}
    for i, x in enumerate(ids):
        a = np.array([*x, 2], "<u4")
        assert sorted(pieces[i]) == [(s, n, zlib.crc32(a[s : s + n].tobytes())) for s, n in cut(len(a))] and counts[i] == len(x)


def test_packing(spark):
    assert cut(1) == [(0, 1)] and cut(1024) == [(0, 1024)] and cut(2050) == [(0, 2), (2, 1024), (1026, 1024)]
    rows = pack_documents(docs(spark, ODD)).collect()
    enc, by_doc, by_seq = encoder(vocabulary_path()), collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(ODD):
        ids = np.append(enc.ids(t), 2).astype("<u4")
        for p, (start, n) in zip(sorted(by_doc[i], key=lambda r: r["piece"]), cut(len(ids)), strict=True):
            assert (p["start"], p["length"], p["ids_crc32"]) == (start, n, zlib.crc32(ids[start : start + n].tobytes()))
    for pieces in by_seq.values():
        assert sum(n for _, n in pieces) <= 1024 and [o for o, _ in sorted(pieces)] == np.cumsum([0] + [n for _, n in sorted(pieces)])[:-1].tolist()
    assert pack_documents(docs(spark, [])).count() == 0


# 2 secrets


def brute_spans(text):
    out = []
    for k, rule in enumerate(RULES):
        fold = rule.pattern.startswith("(?i)")
        pattern = rule.pattern.replace("(?i)", "")
        for m in re.finditer(f"(?:{pattern})(?P<tail>{rule.tail}+)" if rule.tail else f"(?P<tail>{pattern})", text, re.A | (re.I if fold else 0)):
            if len(m["tail"]) >= rule.least:
                out.append((m.start(), m.end(), k))
    return sorted(out)


def test_secrets_equal_expressions():
    own, r = scanner(), random.Random(4)
    parts = ["password", "Passwd", "token", "api_key", "APIKEY", ":", "=", " ", '"', "'", "abc", "ABCD", "AKIA", "0123456789", "deadbeef", "é", "\n", "-", "ghp_", "xoxb-", "-----BEGIN RSA PRIVATE KEY-----", "zzz", "=", "==", "a" * 30, "/", "_"]
    texts = ["".join(r.choice(parts) for _ in range(r.choice([0, 1, 5, 20, 300]))) for _ in range(800)]
    raw, offs = text_bytes(pa.array(texts))
    found = dict(find((raw, offs), own))
    for i, t in enumerate(texts):
        assert found.get(i, []) == brute_spans(t), repr(t)
    assert scan(own.all, np.frombuffer(b"a" * 5000, np.uint8))[1].tolist() == list(range(23, 5000))


def test_secret_rows(spark):
    texts = [*ODD, "é token=abc token: 'abcdef' secret:api_key:abcdefg", "AKIA" + "A" * 16, "0" * 24 + " " + "a" * 23]
    rows = {r["doc_id"]: r for r in secret_spans(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans = brute_spans(t or "")
        base = [s for s in spans if s[2] < 3]
        assert rows[i]["base_sha256"] == hashlib.sha256(joined(base, RULES).encode()).hexdigest() and rows[i]["spans"] == joined(spans, RULES)
        assert [rows[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(s[2] == k for s in base) for k in range(3)]
    assert secret_spans(docs(spark, [])).count() == 0


# 3 language


def prose(r, syllables, n):
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n))


TONGUES = {"en": ["th", "er", "ing", "and", "sh"], "fr": ["é", "eau", "que", "oi", "ç"], "de": ["sch", "ü", "ein", "ß", "keit"], "es": ["ción", "ñ", "rr", "os", "ez"]}


def test_language_held_out(spark):
    r = random.Random(5)
    train = [(prose(r, s, 60), x) for x, s in TONGUES.items() for _ in range(20)]
    model = fit(*map(list, zip(*train, strict=True)))
    texts = [(prose(r, s, 15), x) for x, s in TONGUES.items() for _ in range(50)]
    raw, offs = text_bytes(pa.array([t for t, _ in texts]))
    got = [model.languages[k] for k in model.score(raw, offs)[0].argmax(1)]
    assert sum(g == x for g, (_, x) in zip(got, texts, strict=True)) >= 195
    rows = [(i, t, x if i % 5 else "fr", f"host{i % 7}.{'de' if i % 2 else 'com'}") for i, (t, x) in enumerate(train)] + [(900, None, None, None), (901, "12345 !!!", "en", None), (902, "Ж" * 300, None, "h.com"), (None, train[0][0], "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {x["doc_id"]: x for x in identify_documents(df).collect()}
    assert all(found[i]["language"] == x and found[i]["kept"] for i, (_, x) in enumerate(train))
    assert not found[900]["kept"] and not found[901]["kept"] and found[902]["language"] == "und" and None in found
    assert identify_documents(df.limit(0)).count() == 0


def test_language_of_pages(spark):
    r = random.Random(6)
    rows = [(i, f"http://h{i % 3}.{x}/p", f'<html lang="{x}-XX"><script>th th th</script><p>{prose(r, s, 40)}</p>') for i, (x, s) in enumerate(list(TONGUES.items()) * 6)]
    found = identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((f["page_id"], f["language"]) for f in found) == [(i, x) for i, x in enumerate(list(TONGUES) * 6)]


# 4 decontamination


def brute_hits(texts, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 7)) if w else []:
            windows[tuple(w[k : k + 8])].add(i)
    for t in texts:
        w, own = words(t), set()
        hit = [False] * len(w)
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if k + n <= len(w) and (x := tuple(w[k : k + n])) in windows:
                    own |= windows[x]
                    hit[k : k + n] = [True] * n
        yield len(w), sum(hit), sorted(own)


def test_contamination(spark):
    r = random.Random(7)
    some = lambda n: " ".join(r.choice("abcdeé") for _ in range(n))
    items = [(f"{i % 9}", some(r.choice([0, 1, 3, 7, 8, 9, 20]))) for i in range(14)] + [("n", None)]
    texts = [*ODD, *(some(r.randint(0, 60)) for _ in range(40)), *(f"X, {t} Y" for _, t in items)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for pass_bytes in (64 << 20, 40):
        rows = {x["doc_id"]: x for x in contamination(docs(spark, texts), bench, pass_bytes=pass_bytes).collect()}
        for i, (n, hit, own) in enumerate(brute_hits(texts, items)):
            x = rows[i]
            assert (x["n_words"], x["n_hit"], x["n_items"], x["contaminated"]) == (n, hit, len(own), len(own) >= 2)
            assert x["items_sha256"] == hashlib.sha256(",".join(own).encode()).hexdigest()
    clean = {x["doc_id"] for x in without_matches(docs(spark, texts), bench).collect()}
    assert clean == {i for i, (_, _, own) in enumerate(brute_hits(texts, items)) if not own}
    assert contamination(docs(spark, ["a b"]), bench.limit(0)).first()["n_items"] == 0 and contamination(docs(spark, []), bench).count() == 0


# 5 near duplicates


def test_signatures_are_unbiased():
    r, texts = random.Random(8), []
    for _ in range(150):
        a = [r.choice("abcdefgh") + str(r.randint(0, 40)) for _ in range(r.randint(5, 200))]
        b = list(a)
        for _ in range(r.randint(0, 10)):
            b[r.randrange(len(b))] = "z" + str(r.random())
        texts += [" ".join(a * r.choice([1, 1, 3])), " ".join(b * r.choice([1, 1, 2]))]
    raw, offs = text_bytes(pa.array(texts))
    doc, key, count, _ = shingles(raw, offs)
    sig, _ = compact(signatures(doc, key, count, len(texts)))
    errors = []
    for i in range(0, len(texts), 2):
        x, y = (dict(zip(key[doc == j].tolist(), count[doc == j].tolist(), strict=True)) for j in (i, i + 1))
        both = sum(min(n, y.get(k, 0)) for k, n in x.items())
        true = both / (sum(x.values()) + sum(y.values()) - both)
        errors.append((sig[i] == sig[i + 1]).mean() - true)
        bags = [(key[doc == j], count[doc == j]) for j in (i, i + 1)]
        assert overlaps(bags[0], np.concatenate([bags[1][0], bags[0][0]]), np.concatenate([bags[1][1], bags[0][1]]), np.array([0, len(bags[1][0])])).tolist() == [both, sum(x.values())]
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.06


def brute_classes(texts):
    bags = [collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)) if w) for w in map(words, texts)]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(bags):
        for j, b in enumerate(bags[:i]):
            both = sum((a & b).values())
            if both and both >= 0.8 * (sum(a.values()) + sum(b.values()) - both) - 1e-9:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(texts))]


def test_near_classes(spark):
    r = random.Random(9)
    base = [[f"w{r.randint(0, 5000)}" for _ in range(r.randint(30, 120))] for _ in range(8)]
    texts = list(ODD)
    for k in range(150):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = f"v{k}"
        texts.append(" ".join(w))
    texts += [" ".join([f"u{k % 3}", *base[0][:60]]) for k in range(60)]  # a large bucket
    rows = near_dedup(docs(spark, texts)).collect()
    assert [x["class_id"] for x in sorted(rows, key=lambda x: x["doc_id"])] == brute_classes(texts)
    assert sum(x["kept"] for x in rows) == len(set(brute_classes(texts)))
    assert near_dedup(docs(spark, [])).count() == 0
    assert near_dedup(docs(spark, ["a b c", "a b c"], [None, 5])).count() == 2


def test_components(spark):
    r = random.Random(10)
    links = [(r.randint(0, 120), r.randint(0, 120)) for _ in range(80)] + [(i, i + 1) for i in range(200, 240)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: top(x) for a, b in links if a != b for x in (a, b)}


# 7 media


def test_media(spark):
    texts = [*ODD, "x" * 64, "y" * 65]
    rows = {r["doc_id"]: r for r in media_column(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        codec = re.match("codec=([a-z]+)", r["feature"])[1]
        assert r["media_sha256"] == hashlib.sha256(wave(payload, codec)).hexdigest() and r["media_bytes"] == len(wave(payload, codec))
    assert rows[4]["feature"] == rows[5]["feature"] and media_column(docs(spark, [])).count() == 0


def test_codecs():
    for codec in CODECS:
        assert read(wave(bytes(range(64)), codec)) == (codec, bytes(range(64)))
    with pytest.raises(ValueError):
        read(b"RIFF")
    # fixed points of the companding laws
    assert TABLES["mulaw"][[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0] and TABLES["alaw"][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    from quadloom.llm.media import CHANGES, STEPS, decode_adpcm

    r = np.random.default_rng(0)
    data = r.integers(0, 256, (5, 64), dtype=np.uint8)
    for block, got in zip(data, decode_adpcm(data), strict=True):
        value, index, out = int(block[:2].view("<i2")[0]), min(int(block[2]), 88), []
        out.append(value)
        for b in block[4:].tolist():
            for code in (b & 15, b >> 4):
                step = int(STEPS[index])
                diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
                index = max(0, min(88, index + int(CHANGES[code & 7])))
                out.append(value)
        assert got.tolist() == out
    assert resample(np.array([0, 100, 7], np.int16), np.array([0, 2, 3])).tolist() == [0, 50, 100, 106, 7, 7]


# 8 lines


def brute_lines(texts, least=50):
    """Places (document, line) of runs of at least ``least`` words that stand earlier too; runs of whole lines."""
    lines = [[(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\f\x0b\xa0\u3000")] for t in texts]
    dead = set()
    for d, own in enumerate(lines):
        for e, other in enumerate(lines[: d + 1]):
            for a in range(len(own)):
                for b in range(a if e == d else len(other)):
                    n = total = 0
                    while a + n < len(own) and b + n < len(other) and own[a + n][1] == other[b + n][1]:
                        total += len(re.findall("[^ \\t\\r\\f\x0b\xa0\u3000]+", own[a + n][1]))
                        n += 1
                    if total >= least:
                        dead |= {(d, own[a + k][0]) for k in range(n)}
    return dead


def test_line_dedup(spark):
    r = random.Random(11)
    line = lambda n: " ".join(f"w{r.randint(0, 99)}" for _ in range(n))
    long_ones, blocks_ = [line(60) for _ in range(3)], [[line(r.randint(5, 30)) for _ in range(6)] for _ in range(3)]
    common = line(8)
    texts = [*ODD]
    for _ in range(40):
        parts = [line(r.randint(1, 20)) for _ in range(r.randint(1, 5))]
        x = r.random()
        parts[1:1] = [r.choice(long_ones)] if x < 0.3 else r.choice(blocks_) if x < 0.6 else [common] * 3
        texts.append("\n".join(parts))
    texts.append("\n".join(["a b c d"] * 40))
    rows = {x["doc_id"]: x for x in dedup_lines(docs(spark, texts)).collect()}
    dead = brute_lines(texts)
    for i, t in enumerate(texts):
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in dead)
        assert rows[i]["text"] == kept, (i, t)
    assert dedup_lines(docs(spark, [])).count() == 0
    assert dedup_lines(docs(spark, [texts[9]] * 2, [None, None])).count() == 2


def test_line_dedup_finds_every_earlier_copy(spark):
    """Short quotes of a passage and common lines come first, so that each of its lines has first occurrences elsewhere."""
    r = random.Random(17)
    line = lambda n: " ".join(f"w{r.randint(0, 9999)}" for _ in range(n))
    passage = [line(n) for n in (12, 13, 12, 30)] + [line(9) for _ in range(8)]
    around = lambda x: [line(r.randint(3, 20)), *x, line(r.randint(3, 20))]
    texts = [around(passage[a : a + n]) for n in (2, 3, 4) for a in range(0, 12, 2)] + [around(passage) for _ in range(3)]
    texts += [around(passage[3:7]), around(passage[5:11]), around(passage[1:4]), around(["a b c", "", *passage[4:], " ", *passage[:4]])]
    few = [line(r.choice([4, 9, 18, 30, 55])) for _ in range(5)]  # every order of few lines: runs hide each other
    texts += [[r.choice(few) for _ in range(r.randint(1, 9))] for _ in range(60)]
    texts = ["\n".join(x) for x in texts]
    rows, dead = {x["doc_id"]: x for x in dedup_lines(docs(spark, texts)).collect()}, brute_lines(texts)
    for i, t in enumerate(texts):
        assert rows[i]["text"] == "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in dead), i
        assert rows[i]["n_removed"] == sum((i, k) in dead for k in range(t.count("\n") + 1))


# 9 rollups


def test_rollup(spark, tmp_path):
    enc = encoder(vocabulary_path())
    df = docs(spark, ODD)
    store = TokenRollup(spark, f"file://{tmp_path}/rollup")
    counted = count_tokens(df, tokenizer="v1")
    assert store.totals().count() == 0
    assert store.commit("a", inserts(counted)) and not store.commit("a", inserts(counted))
    total = lambda: store.totals().groupBy().sum("n_docs", "n_tokens", "n_chars").first()
    n = [len(enc.ids(t)) for t in ODD]
    assert tuple(total()) == (len(ODD), sum(n), sum(len(t or "") for t in ODD))
    store.commit("b", deletes(counted.filter("id = 7")))
    store.commit("c", revisions(counted.filter("id = 6"), F.col("tokens") - 5))
    expected = (len(ODD) - 1, sum(n) - n[7] + 5)
    assert tuple(total())[:2] == expected
    assert store.compact() and not store.compact()
    assert tuple(total())[:2] == expected and not store.commit("a", inserts(counted)) and store.open_batches() == [] and store.committed() == ["a", "b", "c"]
    store.commit("d", inserts(counted.limit(0)))
    assert tuple(total())[:2] == expected and store.compact() and tuple(total())[:2] == expected
    assert not store._claim("commits/d", "another writer")
    for bad in ("x/y", "", None, "../x"):
        with pytest.raises(ValueError):
            store.commit(bad, inserts(counted))
    with pytest.raises(Exception, match="unknown change"):
        store.commit("e", inserts(counted).withColumn("op", F.lit("upsert")))


def test_rollup_of_documents(spark, tmp_path):
    """Whatever batches came, replays included: the totals are those of the documents that are left."""
    enc = encoder(vocabulary_path())
    texts = [*ODD, *(f"word {i} tokens" for i in range(30))]
    df = docs(spark, texts).withColumn("tokens", F.lit("clash")).withColumn("id", F.lit("clash"))
    gone = spark.createDataFrame([(7,), (9,), (9,), (99,), (None,)], "id long")
    expected = collections.Counter()
    for i, t in enumerate(texts):
        if i not in (7, 9):
            for version, n in (("byte_bpe_50k", len(enc.ids(t))), ("words", len(words(t)))):
                expected[f"s{i % 3}", "en", version, "docs"] += 1
                expected[f"s{i % 3}", "en", version, "tokens"] += n
                expected[f"s{i % 3}", "en", version, "chars"] += len(t or "")
    got = {}
    for r in rollup_documents(df, gone, f"file://{tmp_path}/store").collect():
        got |= {(r["source"], r["lang"], r["tokenizer"], c): r[f"n_{c}"] for c in ("docs", "tokens", "chars")}
    assert got == dict(expected)
    assert rollup_documents(df.limit(0), gone, f"file://{tmp_path}/none").count() == 0


# 10 shards


def test_sharding(spark):
    rows = shard_documents(docs(spark, [f"t{i}" for i in range(3000)]), Topology.uniform(40)).collect()
    assert all(r["grown_shard"] in (r["shard"], 40) for r in rows)
    assert 30 < sum(r["grown_shard"] == 40 for r in rows) < 130
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len(f"t{r['doc_id']}") + 16 and r["text_crc32"] == zlib.crc32(f"t{r['doc_id']}".encode())
    assert len(slots) == 40 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    odd = shard_documents(docs(spark, ODD, [None, None, 3, 3, 4, 5, 6, 7]), Topology.uniform(3)).collect()
    assert len(odd) == len(ODD) and shard_documents(docs(spark, []), Topology.uniform(3)).count() == 0


def test_movement_stays_in_the_subtree(spark):
    from quadloom.llm.sharding import assign

    tree = Topology.uniform(12, 3, 2)
    ids = spark.range(2000).withColumnRenamed("id", "doc_id")
    moved = assign(assign(ids, tree, F.col("doc_id"), "old"), tree.reweighted(4, 3.0), F.col("doc_id"), "new").filter("old <> new").collect()
    region = {s.number: s.region for s in tree.shards}
    assert moved and all(region[r["new"]] == region[4] for r in moved)
