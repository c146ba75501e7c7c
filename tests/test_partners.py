"""The k best partners against all pairs, and how many pairs the bounds leave out."""

from __future__ import annotations

import math
import random

import pytest

from cadenza.plans import align, partners

OBS = "object_id long, band string, time double, flux double, flux_err double, detected int, tie long"
GRID = dict(translate_time=[-1.0, 0.0, 0.5], translate_flux=[0.0, 2.0], dilate_time=[1.0, 1.1], dilate_flux=[0.5, 1.0])


def _curves(spark, n, amplitudes):
    rng, rows = random.Random(n), []
    for o in range(n):
        a = rng.choice(amplitudes)
        for i in range(rng.randint(1, 14)):
            rows.append((3 * o, rng.choice("ab" if o % 5 else "a"), rng.uniform(0, 20), a * math.sin(i / 2) + rng.gauss(0, a / 10), 0.1, int(rng.random() < 0.95), i))
    rows.append((1000, "a", 1.0, 1.0, 0.1, 0, 0))  # never detected
    return spark.createDataFrame(rows, OBS).repartition(3)


def _all_pairs(spark, obs, grid, k):
    ids = sorted(r.object_id for r in obs.where("detected = 1").select("object_id").distinct().collect())
    meta = spark.createDataFrame([(i, 0) for i in ids], "object_id long, target int")
    found = {}
    for r in align.alignment_matrix(meta, obs, grid).collect():
        found.setdefault(r.left_id, []).append((round(r.arc_length, 6), r.right_id, r.candidate))
    return {i: sorted(own)[:k] for i, own in found.items()}, len(ids)


@pytest.mark.parametrize(("k", "tile", "amplitudes"), [(3, 4, [1.0, 8.0, 50.0]), (1, 7, [1.0, 30.0]), (50, 100, [2.0])])
def test_partners_equal_those_of_all_pairs(spark, k, tile, amplitudes):
    obs, grid = _curves(spark, 24, amplitudes), align.candidate_grid(spark, **GRID)
    got, work = partners.nearest_partners(obs, grid, k, tile)
    want, n = _all_pairs(spark, obs, grid, k)
    mine = {}
    for r in got.orderBy("left_id", "rank").collect():
        own = mine.setdefault(r.left_id, [])
        own.append((r.arc_length, r.right_id, r.candidate))
        assert r.rank == len(own)
    assert mine.keys() == want.keys()
    for i, own in want.items():
        assert [x[1] for x in mine[i]] == [x[1] for x in own]
        assert [x[0] for x in mine[i]] == pytest.approx([x[0] for x in own], abs=2e-6)
    done = work.first()
    assert done.n_pairs == n * (n - 1)
    if len(amplitudes) > 1:
        assert done.n_tried < 0.8 * done.n_pairs  # curves much longer than the best are not tried


def test_few_curves(spark):
    grid = align.candidate_grid(spark)
    obs = spark.createDataFrame([(1, "a", 0.0, 1.0, 0.1, 1, 0), (2, "b", 0.0, 1.0, 0.1, 1, 0)], OBS)
    assert sorted(map(tuple, partners.nearest_partners(obs, grid, 2)[0].collect())) == [(1, 1, 2, 0, 0.0), (2, 1, 1, 0, 0.0)]
    assert partners.nearest_partners(obs.limit(1), grid, 2)[0].count() == 0
    assert partners.nearest_partners(obs.limit(0), grid, 2)[0].count() == 0


def test_tiles_meet_without_copies_on_disk(spark, monkeypatch):
    """points are stored once as tiles; none are exchanged for the tiles that they meet."""
    plans, write = [], partners.stored

    def watched(df, name, **options):
        plans.extend([df._jdf.queryExecution().executedPlan().toString()] * (name == "partners"))
        return write(df, name, **options)

    monkeypatch.setattr(partners, "stored", watched)
    obs, grid = _curves(spark, 24, [1.0, 8.0, 50.0]), align.candidate_grid(spark, **GRID)
    assert partners.nearest_partners(obs, grid, 3, 4)[0].count() == 72
    assert len(plans) == 2 and all("CartesianProduct" in plan and "flux" not in plan for plan in plans)
