from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from parleystat.llm import chain, queries, toxic_spans
from parleystat.llm.common import table
from tests.llm import cases


@pytest.mark.parametrize("lengths", [[1], [3, 1, 5, 4], [9], [2, 2, 2, 7, 1, 1]])
def test_marginals_against_enumeration(lengths):
    rng = np.random.default_rng(len(lengths))
    evidence, ties = rng.normal(size=sum(lengths)) * 2, rng.normal(size=(2, 2))
    bounds = np.cumsum([0, *lengths])
    begins = np.zeros(sum(lengths), bool)
    begins[bounds[:-1]] = True
    chance, pairs = chain.marginals(evidence, begins, ties)
    want, want_pairs = [], np.zeros((2, 2))
    for a, b in zip(bounds[:-1], bounds[1:]):
        paths = list(itertools.product((0, 1), repeat=b - a))
        weight = np.exp([sum(evidence[a + i] * y for i, y in enumerate(p)) + sum(ties[u, v] for u, v in zip(p, p[1:])) for p in paths])
        weight /= weight.sum()
        want += [sum(w for w, p in zip(weight, paths) if p[i]) for i in range(b - a)]
        for w, p in zip(weight, paths):
            for u, v in zip(p, p[1:]):
                want_pairs[u, v] += w
    assert chance == pytest.approx(want) and pairs == pytest.approx(want_pairs)


def test_long_chains_stay_finite():
    rng = np.random.default_rng(0)
    evidence = rng.choice([-500.0, 500.0, 0.0], 200_000)
    begins = np.zeros(len(evidence), bool)
    begins[0] = True
    chance, pairs = chain.marginals(evidence, begins, np.array([[3.0, -3.0], [-3.0, 3.0]]))
    assert np.isfinite(chance).all() and (chance >= 0).all() and (chance <= 1).all()
    assert pairs.sum() == pytest.approx(len(evidence) - 1)


def planted(n=400, seed=3):
    """Texts of invented words; toxic ones hold `vile` or words that begin with `grok`."""
    draw = random.Random(seed)
    plain = ["".join(draw.choice("abcdefgil") for _ in range(draw.randint(2, 8))) for _ in range(500)]
    rows = []
    for k in range(n):
        words, toxic = [draw.choice(plain) for _ in range(draw.randint(5, 80))], k % 4 == 0
        for _ in range(1 + len(words) // 40 if toxic else 0):
            words.insert(draw.randrange(len(words) + 1), draw.choice(["vile", "VILE", "grok" + draw.choice(plain)]))
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_planted_words_are_found_with_their_offsets():
    rows = planted()
    tagger = toxic_spans.learned([t for t, _ in rows[:300]], [y for _, y in rows[:300]])
    scores, spans = toxic_spans.Scorer(tagger)([t for t, _ in rows[300:]])
    labels = np.array([y for _, y in rows[300:]])
    assert ((scores >= 0.5) == labels).mean() > 0.95
    for (text, toxic), found in zip(rows[300:], spans):
        bad = {(m.start(), m.end()) for m in toxic_spans.WORD.finditer(text) if m[0].lower() == "vile" or m[0].startswith("grok")}
        assert not found or {text[a:b].split()[0].lower()[:4] for a, b in found} <= {"vile", "grok"}
        assert not toxic or bad & {(a, b) for a, b in found} or any(a <= x and y <= b for a, b in found for x, y in bad)


def test_long_texts_are_read_in_pieces():
    rows = planted()
    tagger = toxic_spans.learned([t for t, _ in rows], [y for _, y in rows])
    text = " ".join(t for t, _ in rows)
    assert [text[a:b] for a, b in toxic_spans.pieces(text, 50)] and "".join(text[a:b] for a, b in toxic_spans.pieces(text, 50)) == text
    assert sum((toxic_spans.WORD.findall(text[a:b]) for a, b in toxic_spans.pieces(text, 50)), []) == toxic_spans.WORD.findall(text)
    scorer, whole = toxic_spans.Scorer(tagger), toxic_spans.Scorer(tagger)([text])
    keep, toxic_spans.PIECE = toxic_spans.PIECE, 50
    try:
        assert scorer([text])[0].tolist() == whole[0].tolist() and scorer([text])[1] == whole[1]
    finally:
        toxic_spans.PIECE = keep


def test_near_copies_count_once():
    base = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    texts = [base, base + " more", "quite another text with words of its own", base.replace("wordaa", "other")]
    assert toxic_spans.one_of_each(texts) == [0, 2]


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.op13_toxic_spans(spark, folder).join(table(spark, folder, "labels"), "doc_id").where("held_out").collect()
    label, predicted = np.array([r.toxic for r in rows]), np.array([r.predicted for r in rows])
    assert predicted[label == 1].mean() > 0.9
    assert predicted[label == 0].mean() < 0.02
    assert all(0 <= r.score <= 1 and (r.score >= 0.5) == r.predicted for r in rows)


def test_edge_cases(spark):
    docs = cases.docs(spark)
    labels = spark.createDataFrame(
        [(1, 1, 1), (2, 1, 0), (2, 0, 0), (7, 0, 0), (3, 1, 1), (None, 1, 0), (5, None, None), (6, 0, 9)], "doc_id long, quality int, toxic int"
    )
    tagger = toxic_spans.fit(docs, labels)
    rows = toxic_spans.predict(docs, tagger).collect()
    assert len(rows) == len(cases.ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert toxic_spans.predict(cases.no_docs(spark), tagger).collect() == []
    for few in (labels.limit(0), labels.where("toxic = 1"), labels.where("doc_id = 3")):
        blank = toxic_spans.fit(docs, few)
        assert {r.score for r in toxic_spans.predict(docs, blank).collect()} == {0.5}
