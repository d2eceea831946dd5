"""Recursive distance, script and replay of many pairs at once against those of one pair."""

import pyarrow as pa
import pytest
from test_shaped_weighted import documents

from treeloom.operators import nested as N
from treeloom.operators import recursive as R
from treeloom.operators import shaped

COSTS = [R.LATER, R.EARLY, R.Costs(quadratic=True, text=0.5, sections=None)]


@pytest.mark.parametrize("costs", COSTS)
@pytest.mark.parametrize("form", ["json", "items"])
def test_groups_align_as_single_pairs(costs, form):
    docs = documents(4, 120)
    read = N.read_texts(form)
    a, b = read(pa.array(docs)), read(pa.array(docs[::-1]))
    for rows in shaped.groups(a, b):
        g = R.Group([a[r] for r in rows], [b[r] for r in rows], costs)
        one = {r: R.Alignment(a[r], b[r], costs) for r in rows.tolist()}
        for n, r in enumerate(rows.tolist()):
            assert abs((g.total[n] if getattr(g.total, "ndim", 0) else g.total) - one[r].total) < 1e-9
        if not (len(a[rows[0]]) and len(b[rows[0]])):
            continue
        for complete in (False, True):
            met = []
            for own, ops in g.traces(complete):
                met += own.tolist()
                for n in own.tolist():
                    r = int(rows[n])
                    want = one[r].script(complete)
                    assert [(*o[:3], o[4]) for o in ops] == [(*o[:3], o[4]) for o in want]
                    assert [R._brought(a[r] if o[5] == "a" else b[r], o[0], o[6]) for o in ops] == [o[5] for o in want]
            assert sorted(met) == list(range(len(rows)))


def test_round_trips_are_what_replayed_finds(spark):
    docs = documents(5, 80)
    rows = [(i, d, i + 1, e) for i, (d, e) in enumerate(zip(docs, docs[1:]))]
    texts = spark.createDataFrame(rows, "a_id long, a string, b_id long, b string")
    got = {r.a_id: (r.equal, r.exact) for r in R.round_trips(texts, read=N.read_texts("items")).collect()}
    trees = N.trees(spark.createDataFrame([r[:2] for r in rows], "id long, j string"), "id", "j", "items").collect(), N.trees(spark.createDataFrame([(r[0], r[3]) for r in rows], "id long, j string"), "id", "j", "items").collect()
    tree = {n: {r.id: r.tree for r in side} for n, side in enumerate(trees)}
    for i, *_ in rows:
        s, t = (N.Tree.of(tree[n][i]) for n in (0, 1))
        draft = R.Draft(s)
        if len(s) and len(t):
            draft.apply([dict(zip(("op", "path", "at", "cost", "uid", "nodes"), o, strict=True)) for o in R.Alignment(s, t, R.LATER).script(True)])
        after = draft.tree()
        assert got[i] == (after == t, abs(R.Alignment(after, t, R.LATER).total) < 1e-9)
    assert sum(e for e, _ in got.values()) > 70


def test_a_round_trip_that_misses_is_seen():
    read = N.read_texts("items")
    a, b = read(pa.array(['{"p": 1, "q": "x"}'] * 2)), read(pa.array(['{"p": 2, "q": "x"}', '{"p": 1, "q": "y"}']))
    g = R.Group(a, b, R.LATER)
    equal, exact = g.round_trip(shaped.np.arange(2), [])
    assert equal.tolist() == [False, False] and exact.tolist() == [False, True]  # texts cost nothing by LATER
