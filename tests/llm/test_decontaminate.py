from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from parleystat.llm import decontaminate
from tests.llm import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for item, said in items:
            q = words(said)
            n = min(window, len(q))
            runs = {tuple(q[i : i + n]) for i in range(len(q) - n + 1)} if q else set()
            for i in range(len(w) - n + 1) if q else ():
                if tuple(w[i : i + n]) in runs:
                    hit.update(range(i, i + n))
                    names.add(str(item) if item is not None else "")
        out.append((doc_id, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


def found(docs, items, **settings):
    out = decontaminate.with_hits(docs, items, **settings)
    rows = out.select("doc_id", "n_words", decontaminate.n_hit().alias("n"), "items").collect()
    return sorted(((r[0], r[1], r[2], r[3]) for r in rows), key=str)


@pytest.mark.parametrize("block_chars", [1 << 20, 60])
def test_against_brute_force(spark, block_chars):
    rng = random.Random(4)
    vocabulary = ["ab", "AB", "b", "Éa", "éa", "12", "日本", "x-y", "c\u00a0d", "_", "..."]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 4, 12, 15, 30]))) for i in range(14)] + [(3, "ab b 12"), (90, None), (91, "!!"), (None, "b b b b")]
    docs = [(i, text(rng.randrange(120))) for i in range(60)]
    docs += [(100 + i, f"{text(5)}, {t or ''}! {text(5)}") for i, (_, t) in enumerate(items)] + [(200, None), (201, "")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(*frames, block_chars=block_chars) == brute(docs, items)


def test_edge_cases(spark):
    docs = cases.docs(spark)
    items = spark.createDataFrame([(1, "Quick, brown FOX jumps over the lazy dog and runs far"), (2, "")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    kept = decontaminate.clean_documents(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in cases.ROWS if r[0] not in (1, 2)), key=str)
    assert decontaminate.clean_documents(docs, none).count() == len(cases.ROWS)
    assert {r[0]: r[2] for r in found(docs, items)}[1] == 11
    assert found(cases.no_docs(spark), items) == []
    two = decontaminate.clean_documents(docs, items.unionByName(items.select((F.col("item_id") + 5).alias("item_id"), "text")), block_chars=20)
    assert two.count() == kept.count()


@pytest.mark.parametrize("block_chars", [1 << 20, 20])
def test_spans_cut_the_passages_out_of_the_original(spark, block_chars):
    texts = ["é🎉 -- One, TWO é日! x 日本 (three) four…", "one two é日", "none", "", None, "\n🎉one\ttwo é日three FOUR; one\x00Two é日"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two é日"), (2, "Three four…")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.with_hits(docs, items, block_chars=block_chars).collect()}
    cut = {i: [texts[i][s.start : s.end] for s in r.spans] for i, r in rows.items()}
    assert cut == {0: ["One, TWO é日", "three) four…"], 1: ["one two é日"], 2: [], 3: [], 4: [], 5: ["one\x00Two é日"]}
    for i, r in rows.items():
        assert [words(c) for c in cut[i]] == [words(texts[i])[h.first : h.last + 1] for h in r.hits]
