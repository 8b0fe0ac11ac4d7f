"""The registered queries of this subpackage, and the pipeline, on a small table."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from parleystat.llm import queries
from parleystat.llm.common import table
from tests.compare import database, mismatch
from tests.llm import cases
from tests.llm.test_decontaminate import words as item_words
from tests.llm.test_jaccard_join import brute as near_copies
from tests.llm.test_quality_rules import brute as measured
from tests.llm.test_secrets import brute as spans

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    names = set(contract.queries())
    assert set(queries.queries()) | {"pipeline"} <= names
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_twin(spark, name):
    found = queries.queries()[name](spark, FOLDER)
    assert mismatch(found.collect(), found.columns, database(FOLDER), queries.oracle_sql()[name]) is None


def runs(text, n):
    w = item_words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_stages_against_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    items = [item_words(r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, FOLDER)
        if name == "tokens":
            rows = docs.collect()
            assert {r.doc_id for r in rows} == set(before) and all(r.decoded_equal and len(r.ids) == r.n_tokens for r in rows)
            continue
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "quality":
            assert all(not measured(r.text)[-1] for r in after.values())
        if name == "near_copies":
            classes = {d: c for d, _, c in near_copies([(d, r.text) for d, r in before.items()], 5, (8, 10))}
            assert set(after) == {d for d, c in classes.items() if d == c}
        if name == "benchmark_passages":
            windows = {n: {tuple(q[i : i + n]) for q in items if min(10, len(q)) == n for i in range(len(q) - n + 1)} for n in range(1, 11)}
            hit = {d for d, r in before.items() if any(w and runs(r.text, n) & w for n, w in windows.items())}
            assert set(after) == set(before) - hit
        if name == "without_secrets":
            assert set(after) == set(before)
            assert not any(spans(r.text) for r in after.values())
            assert all(after[d] == before[d] for d in after if not spans(before[d].text))


def test_stages_on_odd_rows(spark):
    for docs in (cases.docs(spark), cases.no_docs(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        docs.collect()


def test_workers_remember_few_words_in_the_last_stage(spark, monkeypatch):
    asked = []
    encode = corpus_pipeline.sentencepiece_fst.encode_documents
    monkeypatch.setattr(corpus_pipeline.sentencepiece_fst, "encode_documents", lambda *a, **k: asked.append(k) or encode(*a, **k))
    corpus_pipeline.tokens(spark, cases.no_docs(spark), FOLDER).collect()
    assert asked[0]["remembered"] <= 50_000
