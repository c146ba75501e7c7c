"""What the LSH forest finds by itself, with the exact join of crowds switched off."""

from __future__ import annotations

import random
from itertools import combinations

import brute
import pytest

from cadenza.llm import lsh_forest


def _texts(rng, families, size, template):
    """Families of near copies that differ in a few words; with a template, all share most of their words."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    shared, out = [word() for _ in range(60)], []
    for _ in range(families):
        base = shared[:45] + [word() for _ in range(45)] if template else [word() for _ in range(90)]
        for _ in range(size):
            own = list(base)
            for at in rng.sample(range(90), rng.randint(0, 5)):
                own[at] = word()
            out.append(" ".join(own))
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("families", "size", "template", "region"), [(60, 4, False, 16_384), (12, 30, False, 16_384), (40, 6, True, 16_384), (12, 30, True, 64)])
def test_recall_of_the_forest_alone(spark, monkeypatch, families, size, template, region):
    """Links of similarity 0.8 whose documents end in one group: at least nine in ten, in dense regions too."""
    monkeypatch.setattr(lsh_forest, "REGION", region)
    monkeypatch.setattr(lsh_forest, "OVERLAP", min(16, lsh_forest.OVERLAP) if region < 100 else lsh_forest.OVERLAP)
    monkeypatch.setattr(lsh_forest, "exact_links", lambda placed, percent: spark.createDataFrame([], "a long, b long"))
    docs = _texts(random.Random(families + size), families, size, template)
    sets = {i: brute.shingles(t, 2) for i, t in docs}
    links = [(a, b) for a, b in combinations(sets, 2) if a // size == b // size and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2, 80).collect()}
    recall = sum(found[a] == found[b] for a, b in links) / len(links)
    assert len(links) > 100 and recall >= 0.9
