"""Stored tables and their owners."""

from __future__ import annotations

import os

import pytest

from cadenza.operators import lookups
from cadenza.storage import dropped, owned, shared_path, stored


def test_an_owner_clears_what_was_stored(spark):
    """Tables that a lazy result still reads stay until the block ends, those of an outer block longer."""
    table = spark.range(50).withColumnRenamed("id", "object_id")
    with owned(spark) as outer:
        kept = stored(table, "kept")
        with owned(spark) as inner:
            placed = lookups.numbered(table, "object_id")
            assert [r.pos for r in placed.orderBy("pos").collect()] == list(range(50))
            assert inner and all(os.path.isdir(p) for p in inner)
        assert not any(os.path.exists(p) for p in inner) and kept.count() == 50 and len(outer) == 1
    assert not any(os.path.exists(p) for p in outer)


def test_an_owner_clears_after_an_error(spark):
    with pytest.raises(ValueError), owned(spark) as paths:
        stored(spark.range(3), "some")
        raise ValueError
    assert len(paths) == 1 and not os.path.exists(paths[0])


def test_dropped_and_free_paths(spark):
    table = stored(spark.range(3), "some")
    path = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    dropped(table, None)
    assert not os.path.exists(path) and shared_path(spark, "x") != shared_path(spark, "x")
