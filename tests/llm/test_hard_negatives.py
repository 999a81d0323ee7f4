"""Hard negatives against brute force."""
import math
import random

import numpy as np
import pytest

from tidegauge.llm import hard_negatives
from tidegauge.llm.hard_negatives import LEAST, MOST, mine_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, score double, page int"


def slow(rows, every, k, n, low, high):
    whole = {}
    for i, x, label, *_ in rows:
        if i is not None and x is not None and label is not None and all(v is not None and math.isfinite(v) for v in x):
            v = tuple(math.floor(float(np.float32(a)) * 256) for a in x)
            whole[i, label, v + (0,) * (4 - len(v))] = True
    whole = list(whole)
    score = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), LEAST), MOST)       # noqa: E731
    out = []
    for i, label, v in whole:
        if i % every == 0:
            others = sorted((-score(v, w), j, other == label) for j, other, w in whole if j != i)
            for s, p, _ in [o for o in others if o[2]][:k]:
                fits = [(j, -t) for t, j, same in others if not same and low * -s <= 100 * -t <= high * -s][:n]
                out += [(i, p, r + 1, j, -s, t) for r, (j, t) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **kw):
    return sorted(tuple(r) for r in mine_negatives(spark.createDataFrame(rows, SCHEMA), **kw).collect())


@pytest.fixture
def rows():
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(5)]
    out = []
    for i in range(400):
        c = centres[i % 5]
        out.append((i, [a + rng.gauss(0, 0.3) for a in c], rng.randrange(3) if i % 3 else 1, "x", 0.0, 1))
    out += [(500, out[7][1], 1, "x", 0.0, 1), (501, out[7][1], 1, "x", 0.0, 1), (502, out[7][1], 2, "x", 0.0, 1)]          # ties
    out += [out[10], out[10], (10, [1.0, 2.0, 0.5, 0.25], 2, "y", 1.0, 2)]                                        # repeated rows, and another with the id
    out += [(None, [1.0] * 4, 1, None, None, None), (600, None, 1, None, None, None), (610, [1.0] * 4, None, None, None, None),
            (620, [1.0, None, 1.0, 1.0], 1, None, None, None), (630, [1.0, float("nan"), 1.0, 1.0], 1, None, None, None),
            (640, [float("inf"), 1.0, 1.0, 1.0], 1, None, None, None), (650, [0.0] * 4, 1, None, None, None), (660, [], 2, None, None, None), (670, [2.0], 0, None, None, None)]
    return out


@pytest.mark.parametrize("page, block", [(2048, 1 << 25), (16, 1)])
def test_negatives(spark, rows, page, block):
    assert mined(spark, rows, every=10, page=page, block_bytes=block) == slow(rows, 10, 5, 10, 30, 90)


def test_more_of_both(spark, rows):
    assert mined(spark, rows, every=7, positives=2, negatives=3, least=50, most=100) == slow(rows, 7, 2, 3, 50, 100)


def test_great_numbers(spark):
    vectors = [(1e7, 1.0), (1e7, 0.0), (1.0, 2.0), (1.0, 0.5), (3e7, 1e7), (-1e7, 3.0), (1e30, 1.0), (2e7, 5.0), (5e6, 0.1), (9e6, 7.0)]
    rows = [(i, list(v), i % 2, None, None, None) for i, v in enumerate(vectors)]
    got = mined(spark, rows, every=1)
    assert got == slow(rows, 1, 5, 10, 30, 90) and any(abs(r[4]) > 2 ** 55 for r in got)


def test_bounds_hold():
    rng = np.random.default_rng(4)
    rows = np.floor(rng.normal(size=(300, 6)) * 256)
    rows[0], rows[1], rows[2] = rows[3], -rows[3], 0
    norms = hard_negatives.lengths(rows)
    directions = hard_negatives.fit_directions(rows)
    angle = hard_negatives.angles(rows, norms, directions).astype(np.float32).astype(float)
    scores = rows @ rows.T
    for a in range(300):
        low, high = hard_negatives.row_bounds(angle[a], norms[a], np.cos(angle), np.sin(angle), norms)
        assert (low <= scores[a]).all() and (scores[a] <= high).all()
    for first in range(0, 300, 25):
        part = slice(first, first + 25)
        low, high = hard_negatives.page_bounds(angle, norms, angle[part].min(axis=0), angle[part].max(axis=0), norms[part].min(), norms[part].max())
        assert (low <= scores[:, part].min(axis=1)).all() and (scores[:, part].max(axis=1) <= high).all()


def test_close_groups_are_passed_over():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = centres[np.arange(600) % 6] + rng.normal(size=(600, 8)) * 0.02
    norms = hard_negatives.lengths(rows)
    angle = hard_negatives.angles(rows, norms, hard_negatives.fit_directions(rows))
    passed = [np.count_nonzero(hard_negatives.row_bounds(angle[a], norms[a], np.cos(angle), np.sin(angle), norms)[1] < 0.5 * norms[a] ** 2) for a in range(20)]
    assert np.mean(passed) > 250


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1, None, None, None)]) == []
    assert mined(spark, [(0, [1.0], 1, None, None, None), (1, [1.0], 1, None, None, None)]) == []
    assert mined(spark, [(5, [1.0], 1, None, None, None), (1, [1.0], 2, None, None, None)], every=100) == []
