from __future__ import annotations

import itertools

import numpy as np
import pytest

from parleystat.llm import line_quality as lq
from parleystat.llm import queries
from parleystat.llm.common import table
from tests.llm import cases


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    lengths = [1, 4, 2, 6, 3]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    evidence, ties = rng.normal(size=bounds[-1]), rng.normal(size=(2, 2))
    good, pairs, total = lq.forward_backward(evidence, bounds, ties)
    want_good, want_pairs, want_total = [], np.zeros((2, 2)), 0.0
    for a, b in zip(bounds[:-1], bounds[1:]):
        paths = list(itertools.product((0, 1), repeat=b - a))
        weight = np.array([
            np.exp(sum(evidence[a + i] * y for i, y in enumerate(p)) + sum(ties[u, v] for u, v in zip(p, p[1:]))) for p in paths
        ])
        share = weight / weight.sum()
        want_total += np.log(weight.sum())
        want_good += [sum(s for s, p in zip(share, paths) if p[i]) for i in range(b - a)]
        for s, p in zip(share, paths):
            for u, v in zip(p, p[1:]):
                want_pairs[u, v] += s
    assert good == pytest.approx(want_good)
    assert pairs == pytest.approx(want_pairs)
    assert total == pytest.approx(want_total)


def test_features_use_neighbours_but_not_other_texts():
    alone = lq.lines_of(["a b c\nD E"])
    beside = lq.lines_of(["X X X", "a b c\nD E", None])
    assert np.array_equal(alone.features, beside.features[1:3])
    assert beside.bounds.tolist() == [0, 1, 3, 4]
    assert beside.features[2, lq._OWN : 2 * lq._OWN].tolist() == beside.features[1, : lq._OWN].tolist()


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.op9_line_quality(spark, folder).join(table(spark, folder, "labels"), "doc_id").where("held_out").collect()
    score, label = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    order = np.argsort(np.argsort(score)) + 1
    good, bad = (label == 1).sum(), (label == 0).sum()
    area = (order[label == 1].sum() - good * (good + 1) / 2) / (good * bad)
    assert area > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_edge_cases(spark):
    docs = cases.docs(spark)
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (2, 0, 0), (7, 0, 0), (3, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int"
    )
    model = lq.fit(docs, labels)
    rows = lq.predict(docs, model).collect()
    assert len(rows) == len(cases.ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert lq.predict(cases.no_docs(spark), model).collect() == []
    blank = lq.fit(docs, labels.limit(0))
    assert {r.score for r in lq.predict(docs, blank).collect()} == {0.5}
