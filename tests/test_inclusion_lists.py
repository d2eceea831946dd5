"""Containment where many trees have one shape: ids meet as lists."""

import pytest

from treeloom.operators import compare as C
from treeloom.operators import nested as N


@pytest.mark.parametrize("listed", [1, 2, 1000])
def test_lists_of_ids_give_every_pair(spark, monkeypatch, listed):
    monkeypatch.setattr(C, "LISTED", listed)
    docs = ["<article><p></p></article>", "<article><p></p><b></b></article>", "<div><article><p>x</p></article></div>", "<i></i>", None]
    rows = spark.createDataFrame([(i, docs[i % 5]) for i in range(25)], "id long, html string")
    trees = N.trees(rows, "id", "html", "markup")
    found = C.inclusions(C.subtrees(trees, "article"), trees)
    assert "pattern_id_part" in found._jdf.queryExecution().analyzed().toString()
    got = sorted((r.pattern_id, r.id) for r in found.collect())
    small, wide = [i for i in range(25) if i % 5 in (0, 2)], [i for i in range(25) if i % 5 == 1]
    assert got == sorted([(p, t) for p in small for t in [*small, *wide]] + [(p, t) for p in wide for t in wide])
