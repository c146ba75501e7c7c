"""Merged lengths of two tiles against pairs merged one by one."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from cadenza.plans import align, partners
from cadenza.plans.tiles import Points, merged_lengths

GRID = np.array(list(product((-1.0, 0.0, 1.0), (0.0, 2.0), (1.0, 1.5, -1.0), (0.5, 1.0))))


def _points(rng, n, whole):
    counts = rng.integers(0, 15, n)
    band, time = rng.integers(0, 3, counts.sum()), rng.uniform(0, 8, counts.sum())
    time, flux = np.floor(time) if whole else time, rng.normal(0, 5, counts.sum())
    order = np.lexsort((time, band, np.repeat(np.arange(n), counts)))
    return Points(counts, band[order], time[order], flux[order])


def _curve(points, i, b):
    rows = slice(points.first[i], points.first[i] + points.counts[i])
    own = points.band[rows] == b
    return points.time[rows][own], points.flux[rows][own]


def _length(left, i, right, j, p):
    total = 0.0
    for b in range(3):
        (t, f), (u, g) = _curve(left, i, b), _curve(right, j, b)
        time, flux = np.append(t, p[2] * (u + p[0])), np.append(f, p[3] * (g + p[1]))
        order = np.lexsort((np.append(np.zeros(len(t)), np.ones(len(u))), time))  # left ones first, each side as given
        total += np.hypot(np.diff(time[order]), np.diff(flux[order])).sum()
    return total


@pytest.mark.parametrize(("whole", "some"), [(False, False), (True, False), (True, True)])
def test_lengths_equal_those_of_single_pairs(whole, some, monkeypatch):
    monkeypatch.setattr("cadenza.plans.tiles.LEFTS", 7)
    rng = np.random.default_rng(3)
    left, right = _points(rng, 16, whole), _points(rng, 9, whole)
    wanted = rng.random((16, 9)) < 0.5 if some else None
    met = np.zeros((16, 9), int)
    for of, j, lengths in merged_lengths(left, right, GRID, 3, wanted):
        met[of, j] += 1
        for at, i in enumerate(of):
            assert lengths[:, at] == pytest.approx([_length(left, i, right, j, p) for p in GRID], abs=1e-9)
    assert (met == (1 if wanted is None else wanted)).all()


def test_matrix_by_tiles(spark):
    """Small tiles give what one tile gives, objects without points included; pairs are not shuffled or sorted."""
    rows = [(i, "ab"[j % 2], float((i * j) % 7), float((i + 3 * j) % 5), 1, j) for i in range(9) for j in range(i % 4)]
    obs = spark.createDataFrame(rows, "object_id long, band string, time double, flux double, detected int, tie long")
    meta = spark.createDataFrame([(i, None if i == 5 else i % 2) for i in range(9)], "object_id long, target int")
    grid = align.candidate_grid(spark, (0.0, 1.0), (0.0,), (1.0,), (1.0, 0.5))
    whole = align.alignment_matrix(meta, obs, grid)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan
    for same in (False, True):
        one, many = (sorted(map(str, align.alignment_matrix(meta, obs, grid, same, tile).collect())) for tile in (512, 2))
        assert one == many
        empty = {i for i in range(9) if i % 4 == 0}
        pairs = [(i, j) for i in range(9) for j in range(9) if i != j and not {i, j} <= empty and (not same or (i % 2 == j % 2 and 5 not in (i, j)))]
        assert len(one) == len(pairs)


def test_tiles_meet_without_copies_on_disk(spark):
    """curves are stored once; no exchange hands them to the tiles that they meet."""
    rows = [(i, "ab"[j % 2], float(j), float((i + 3 * j) % 5), 1, j) for i in range(20) for j in range(6)]
    obs = spark.createDataFrame(rows, "object_id long, band string, time double, flux double, detected int, tie long")
    meta = spark.createDataFrame([(i, i % 2) for i in range(20)], "object_id long, target int")
    for same in (False, True):
        made = align.alignment_matrix(meta, obs, align.candidate_grid(spark), same, tile=2)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
        assert made.count() == (180 if same else 380)


def test_partners_merge_no_pair_by_itself(monkeypatch):
    def merged(*_):
        raise AssertionError("a pair was merged by itself")

    monkeypatch.setattr(align.Curves, "lengths", merged)
    rng = np.random.default_rng(5)
    n = 6
    of = np.tile(np.repeat(np.arange(n), 4), 2)
    table = pa.table({"side": np.repeat([0, 1], 4 * n), "object_id": of, "band": ["a"] * 8 * n, "time": np.tile(np.arange(4.0), 2 * n), "flux": rng.normal(0, 1, 4 * n)[np.arange(8 * n) % (4 * n)],
        "length": np.zeros(8 * n), "bound": np.full(8 * n, np.inf)})
    grid = GRID[GRID[:, 2] > 0]
    found, tried, pairs = partners._best(table, grid, 2)
    assert tried == pairs == n * (n - 1) and found["left_id"].tolist() == np.repeat(np.arange(n), 2).tolist()
    points = Points(np.full(n, 4), np.zeros(4 * n, int), table["time"].to_numpy()[: 4 * n], table["flux"].to_numpy()[: 4 * n])
    for i in range(n):
        least = sorted((round(min(_length(points, i, points, j, p) for p in grid), 6), j) for j in range(n) if j != i)
        assert found["right_id"][found["left_id"] == i].tolist() == [j for _, j in least[:2]]
