"""Neighbours by projections against brute force: recall, exact ties, many blocks and lots, odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import projected_search as ps
from quillspark.llm import ranks

ROWS = "vec_id bigint, embedding array<double>, label int, score string"


def frame(spark, ids, vectors):
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], 0, "clash") for i, v in zip(ids, vectors, strict=True)], ROWS).repartition(3)


def brute(ids, vectors, k=5, every=50):
    """By query: (score, id) of the k nearest, and the score of the last."""
    width = max(len(v) for v in vectors)
    v = np.array([[*x, *[0.0] * (width - len(x))] for x in vectors], dtype=float)
    u = v / np.sqrt((v * v).sum(axis=1))[:, None]
    ids = np.array(ids)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = np.round(u @ u[i], 12)
        free = np.flatnonzero(ids != ids[i])
        out[int(ids[i])] = [(float(s[j]), int(ids[j])) for j in free[np.lexsort((ids[free], -s[free]))[:k]]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((round(r.score, 12), r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.fixture
def small(monkeypatch):
    """Many blocks, cells and lots for few rows."""
    monkeypatch.setattr(ps, "BLOCK", 64)
    monkeypatch.setattr(ps, "LEAF", 4)
    monkeypatch.setattr(ps, "LOT_BYTES", 4096)
    monkeypatch.setattr(ps, "AT_ONCE", 3)
    monkeypatch.setattr(ranks, "FEW", 100)


def test_chi_square():
    drawn = (np.random.default_rng(0).standard_normal((100_000, ps.DIMS)) ** 2).sum(axis=1)
    for p in (0.1, 0.5, 0.9, 0.95):
        assert abs((drawn <= ps.reach(p)).mean() - p) < 0.01 and abs(ps.chi_square(ps.reach(p)) - p) < 1e-9
    assert ps.reach(1.0) == math.inf and ps.chi_square(0.0) == 0


@pytest.mark.parametrize("n", [1, 3, 31, 64, 257])
def test_boxes_hold_their_rows(n):
    points = np.random.default_rng(n).standard_normal((n, ps.DIMS))
    order, lows, highs = ps.kd_tree(points)
    bounds = ps._bounds(n)
    assert sorted(order) == list(range(n)) and len(lows) == 2 * (len(bounds) - 1)
    for leaf, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False), len(bounds) - 1):
        while leaf:
            assert (points[order[a:b]] >= lows[leaf]).all() and (points[order[a:b]] <= highs[leaf]).all()
            leaf //= 2


def test_exact_with_full_confidence_and_copies(spark, small):
    rng = np.random.default_rng(1)
    vectors = [*rng.standard_normal((300, 8)), *[np.arange(8.0) + 1] * 200, *[[1.0, 0, 2]] * 3]
    ids = rng.permutation(len(vectors)).tolist()
    found = ps.nearest(frame(spark, ids, vectors), F.col("vec_id") % 50 == 0, confidence=1.0)
    assert answers(found) == brute(ids, vectors)
    assert abs(found.first().verified_share - 1) < 0.01  # all but the queries' own rows


@pytest.mark.parametrize("kind", ["noise", "clusters"])
def test_recall(spark, small, kind):
    rng = np.random.default_rng(2)
    n = 2000
    vectors = rng.standard_normal((n, 32)) + (0 if kind == "noise" else 6 * rng.standard_normal((40, 32))[rng.integers(40, size=n)])
    ids = (rng.permutation(n) * 7).tolist()
    found = ps.nearest(frame(spark, ids, vectors), F.col("vec_id") % 50 == 0)
    got, want = answers(found), brute(ids, vectors)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = [len({i for _, i in got[q]} & {i for _, i in want[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.9
    assert found.first().verified_share < (0.95 if kind == "noise" else 0.2)


def test_copies_of_a_query_are_found_at_any_confidence(spark, small):
    rng = np.random.default_rng(4)
    vectors = [*[np.ones(16)] * 400, *rng.standard_normal((200, 16))]
    ids = rng.permutation(600).tolist()
    got, want = answers(ps.nearest(frame(spark, ids, vectors), F.col("vec_id") % 50 == 0)), brute(ids, vectors)
    copies = {i for i, v in zip(ids, vectors, strict=True) if (v == 1).all()}
    assert all(got[q] == want[q] for q in want if q in copies)


def test_odd_vectors(spark):
    odd = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]]
    good = [[1e200, 1e200], [1e-200, 0.0], [3.0, 4.0], [1.0, 1.0, 1.0], [-1.0, 0.0]]
    rows = frame(spark, [100, 150, 200, 250, 300, 350, 0, 1, 2, 3, 4], [*odd, *good])
    found = answers(ps.nearest(rows.union(spark.createDataFrame([(None, [1.0], 0, "")], ROWS)), F.col("vec_id") % 50 == 0))
    assert [i for _, i in found[0]] == [2, 3, 1, 4] and found.keys() == {0}
    assert abs(found[0][2][0] - math.sqrt(0.5)) < 1e-12
    assert ps.nearest(rows.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ps.nearest(frame(spark, [0], [[1.0]]), F.col("vec_id") % 50 == 0).count() == 0
    twice = answers(ps.nearest(frame(spark, [0, 0, 7, 7], [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.0, 2.0]]), F.col("vec_id") % 50 == 0))
    assert twice == {0: [(1.0, 7), (round(math.sqrt(0.5), 12), 7)]}  # asked with [0, 1], the least of its vectors
    assert ps.recall(frame(spark, [0, 1, 2], [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]), F.col("vec_id") % 50 == 0) == 1.0
