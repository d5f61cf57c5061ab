"""Hard negatives: equal to all pairs, whatever the cells are; bounds hold; odd rows."""

import math
import random

import numpy as np
import pytest

from packlake.llm import hard_negatives
from packlake.llm.hard_negatives import mine

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    kept = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    last = float("inf")
    found = []
    for a_id, a_label, a in kept:
        if a_id is None or a_id % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, v)), last if k is None else k, k, label) for k, label, v in kept if k != a_id]
        scored.sort(key=lambda r: r[:2])
        for s, _, p_id, _ in [r for r in scored if r[3] == a_label][:positives]:
            window = [r for r in scored if r[3] != a_label and low * -s <= 100 * -r[0] <= high * -s]
            found += [(a_id, p_id, k + 1, r[2], -s, -r[0]) for k, r in enumerate(window[:negatives])]
    return sorted(found, key=str)


def mined(spark, rows, **how):
    return sorted((tuple(r) for r in mine(spark.createDataFrame(rows, SCHEMA), **how).collect()), key=str)


def clustered(n, seed, dims=8, labels=4):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(labels * 2, dims))
    rows = []
    for k in range(n):
        near = draw.integers(len(middles))
        vector = middles[near] + 0.15 * draw.normal(size=dims)
        rows.append((k, [float(x) for x in vector / np.linalg.norm(vector)], int(near % labels)))
    return rows


def test_clusters(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 8)
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    rows = clustered(700, 1)
    assert mined(spark, rows, every=10) == brute(rows, every=10)


def test_cells_are_left_out_when_certain(monkeypatch):
    """On clusters the heap stops early: far fewer cells reach the needed score than there are."""
    rows = clustered(4000, 2)
    vectors = np.floor(256 * np.array([r[1] for r in rows]))
    halves = vectors[:, :4], vectors[:, 4:]
    index = hard_negatives.Index(tuple(hard_negatives._codebook(h, 16) for h in halves), ((), ()), np.zeros((16, 16), int), 8)
    (a, away_a), (b, away_b) = index.nearest(vectors)
    index.radii = tuple(np.array([away[w == k].max(initial=0) for k in range(16)]) for w, away in ((a, away_a), (b, away_b)))
    np.add.at(index.counts, (a, b), 1)
    scores = vectors @ vectors[0]
    cells = list(index.cells(vectors[0]))
    assert len(cells) == (index.counts > 0).sum()
    bounds = [most for _, most, _ in cells]
    assert bounds == sorted(bounds, reverse=True)
    for cell, most, least in cells:
        inside = scores[(a * 16 + b) == cell]
        assert inside.max() <= most and inside.min() >= least
    need = np.sort(scores)[-6]
    assert sum(most >= need for most in bounds) < len(bounds) / 3


def test_one_vector_has_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 8)
    rows = clustered(200, 3)
    rows += [(k, rows[0][1], k % 3) for k in range(200, 300)]
    assert mined(spark, rows, every=25) == brute(rows, every=25)


def test_odd_rows(spark):
    rows = clustered(60, 4, dims=3)
    rows += [
        (100, None, 1),
        (150, [0.5, None, 0.5], 1),
        (200, [float("nan"), 0.1, 0.2], 1),
        (250, [float("inf"), 0.1, 0.2], 1),
        (300, [0.1, 0.9, 0.2], None),
        (None, rows[3][1], rows[3][2]),  # may be found, comes last among equals
        (350, [], 1),
        (400, [0.9], 2),  # shorter: the rest counts nothing
        rows[0],  # a repeated row
        rows[7],
    ]
    assert mined(spark, rows, every=10, positives=9) == brute(rows, every=10, positives=9)


@pytest.mark.parametrize("rows", [[], [(3, [0.1], 1)], [(50, [0.1, 0.2], 1)], [(50, None, 1)], [(50, [0.1], 1), (51, [0.2], 1)]])
def test_few_rows(spark, rows):
    assert mined(spark, rows) == []


def test_clashing_columns(spark):
    rows = clustered(120, 6)
    wide = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], SCHEMA + ", cell int, anchor string, score double")
    assert sorted((tuple(r) for r in mine(wide).collect()), key=str) == brute(rows)


def test_large_components_are_exact(spark):
    draw = random.Random(8)
    rows = [(k, [float(np.float32(draw.uniform(-1e6, 1e6))) for _ in range(6)], k % 2) for k in range(120)]
    assert mined(spark, rows, every=20) == brute(rows, every=20)
