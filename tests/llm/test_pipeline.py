"""The pipeline against a composition of the brute-force operators."""

import collections
import random
import zlib

import numpy as np

import corpus_pipeline
from quadloom.llm.packing import cut
from quadloom.llm.tokens import encoder, vocabulary_path
from tests.llm.test_operators import TONGUES, brute_classes, brute_hits, brute_lines, prose


def corpus(r):
    syllables = TONGUES["en"] + ["re", "on", "es", "nd", "tion"]
    base = ["\n".join(prose(r, syllables, r.randint(8, 40)) for _ in range(r.randint(1, 5))) for _ in range(50)]
    passage, item = prose(r, syllables, 60), prose(r, syllables, 20)
    texts = list(base)
    texts += [base[0], base[1]]  # exact copies
    for k in range(6):  # near copies: one word of many in one line
        w = base[2 + k].split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [f"{prose(r, syllables, 9)}\n{passage}\n{prose(r, syllables, 9)}" for _ in range(4)]
    texts += [f"{prose(r, syllables, 30)} {item} {prose(r, syllables, 30)}"]
    return [*texts, None, "", "123 456 !!", "Ж" * 200], [("b1", item), ("b2", prose(r, syllables, 30))]


def test_pipeline_equals_brute_force(spark, tmp_path):
    r = random.Random(12)
    texts, items = corpus(r)
    rows = [(i, t, "en" if t and i < len(texts) - 4 else None, f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")

    live = [(i, t) for i, t in enumerate(texts[:-4])]  # the last four have no language
    dead = brute_lines([t for _, t in live])
    after = []
    for d, (i, t) in enumerate(live):
        lines = t.split("\n")
        kept = "\n".join(x for k, x in enumerate(lines) if (d, k) not in dead)
        if kept.strip() or not any((d, k) in dead for k in range(len(lines))):
            after.append((i, kept))
    classes = brute_classes([t for _, t in after])
    after = [x for k, x in enumerate(after) if classes[k] == k]
    hits = [own for _, _, own in brute_hits([t for _, t in after], items)]
    expected = dict(x for x, own in zip(after, hits, strict=True) if not own)

    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"file://{tmp_path}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert {x["doc_id"]: x["text"] for x in docs.collect()} == expected

    found = collections.defaultdict(dict)
    for x in corpus_pipeline.run(spark, f"file://{tmp_path}").collect():
        found[x["doc_id"]][x["piece"]] = x["ids_crc32"]
    enc = encoder(vocabulary_path())
    assert found.keys() == expected.keys()
    for i, t in expected.items():
        ids = np.append(enc.ids(t), 2).astype("<u4")
        assert found[i] == {k: zlib.crc32(ids[a : a + n].tobytes()) for k, (a, n) in enumerate(cut(len(ids)))}
