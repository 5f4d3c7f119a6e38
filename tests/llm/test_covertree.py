"""Operator 12: cover trees against brute force."""
from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightjar.llm import covertree
from nightjar.llm.covertree import Tree


def clouds(seed, n, width, spread=90):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (7, width))
    return (centres[rng.integers(0, 7, n)] + rng.normal(0, spread, (n, width))).round()


def best(points, ids, labels, q, own, label, same, window, keep):
    scores = points.astype(np.int64) @ q.astype(np.int64)
    fits = ((labels == label) == same) & (ids != own) & (scores >= window[0]) & (scores <= window[1])
    return sorted(zip((-scores[fits]).tolist(), ids[fits].tolist()))[:keep]


@pytest.mark.parametrize("n, width, spread", [(1, 3, 10), (3000, 2, 30), (2500, 16, 4), (1500, 64, 90), (700, 5, 0)])
def test_tree_invariants_and_search(n, width, spread):
    points = clouds(n, n, width, spread)
    ids, labels = np.random.default_rng(1).permutation(n).astype(np.int64), (np.arange(n) % 5).astype(np.int64)
    tree = Tree.from_bytes(Tree.build(points, ids, labels).to_bytes())
    assert sorted(tree.ids.tolist()) == list(range(n))
    real = tree.points.astype(float)
    norms = (real * real).sum(1)
    lifted = np.column_stack([real, np.sqrt(norms.max() - norms)])
    for k in range(len(tree.start)):
        gap = np.sqrt(((lifted[tree.start[k]:tree.end[k]] - lifted[tree.centre[k]]) ** 2).sum(1))
        assert gap.max() <= tree.radius[k] * (1 + 1e-9) + 1e-3
        spans = [(tree.start[c], tree.end[c]) for c in range(tree.child[k], tree.child_end[k])]
        if spans:
            assert spans[0][0] == tree.start[k] and spans[-1][1] == tree.end[k]
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    skipped = 0
    for q in range(0, n, max(1, n // 40)):
        top = best(points, ids, labels, points[q], ids[q], labels[q], True, (-2 ** 62, 2 ** 62), 5)
        windows = [(math.ceil(-s * 0.3), math.floor(-s * 0.9)) for s, _ in top if s < 0] + [(5, 4), (-2 ** 62, 2 ** 62)]
        for same in (True, False):
            found, seen = tree.search(points[q], ids[q], labels[q], same, windows, 10)
            skipped += seen < (tree.child == tree.child_end).sum()
            for w, (scores, at) in zip(windows, found):
                assert list(zip((-scores).tolist(), at.tolist())) == best(
                    points, ids, labels, points[q], ids[q], labels[q], same, w, 10)
    assert skipped or n < 1000 or width > 20      # nodes outside the windows are not visited


def slow(rows, positives=5, negatives=10):
    real = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            v = [math.floor(256 * x) for x in v]
            if sum(x * x for x in v) < 2 ** 61:
                real.append((i, label, v))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    anchors = {}
    for i, label, v in real:
        if i % 10 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    for a, (label, v) in anchors.items():
        others = sorted((-score(v, w), i, lab) for i, lab, w in real if i != a)
        for ps, p, _ in [o for o in others if o[2] == label][:positives]:
            hard = [(i, -s) for s, i, lab in others if lab != label and 30 * -ps <= 100 * -s <= 90 * -ps][:negatives]
            out += [(a, p, k + 1, i, -ps, s) for k, (i, s) in enumerate(hard)]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    pull = rng.normal(0, 0.3, (3, 8))
    rows = [(int(i), int(rng.integers(0, 3)), (rng.normal(0, 0.3, 8) + pull[i % 3]).tolist()) for i in range(400)]
    rows += [(401, None, [1.0] * 8), (402, 1, None), (403, 1, [1.0, None] + [0.0] * 6), (404, 1, [float("nan")] * 8),
             (405, 1, [float("inf")] * 8), (None, 1, [0.1] * 8), (407, 2, [0.5, 0.5]), (408, 1, []), (410, 2, []),
             (412, 0, [1e300] * 8), (409, 0, [2.0 ** 20] * 8), (420, 7, [0.1] * 8), (430, 1, rows[13][2]), (431, 1, rows[13][2]),
             (431, 2, rows[13][2]), (440, 1, rows[20][2]), (440, 0, rows[21][2]), (441, 0, [-x for x in rows[0][2]])]
    table = spark.createDataFrame([(*r, 1, "a") for r in rows],
                                  "vec_id long, label int, embedding array<double>, id long, v string")
    want = slow(rows)
    assert len(want) > 500
    for per_tree, part in ((100, 7), (8192, 128)):
        got = covertree.hard_negatives(table.repartition(3), F.expr("id % 10 = 0"), per_tree=per_tree, part=part)
        assert sorted(map(tuple, got.collect())) == want
    assert covertree.hard_negatives(table.limit(0), F.expr("id % 10 = 0")).count() == 0
    assert covertree.hard_negatives(table.where("label = 0"), F.expr("id % 10 = 0")).count() == 0


def test_one_hot_label_and_equal_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, 1 if i % 3 else 2, [0.5, 0.5, -0.25] if i % 2 else rng.normal(0, 1, 3).tolist()) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = covertree.hard_negatives(table, F.expr("id % 10 = 0"), per_tree=64, part=16)
    assert sorted(map(tuple, got.collect())) == slow(rows)
