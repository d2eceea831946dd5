"""Comparison of many pairs at once against that of one pair by every method."""

import pyarrow as pa
from test_shaped_weighted import documents

from treeloom.operators import compare as C
from treeloom.operators import nested as N
from treeloom.operators import shaped


def test_groups_compare_as_single_pairs():
    docs = [*documents(2, 150), '{"p": "12", "q": "inf", "r": 12}', '{"p": 12, "q": Infinity, "r": "x"}']
    for form in ("json", "items"):
        read = N.read_texts(form)
        a, b = read(pa.array(docs)), read(pa.array(docs[::-1]))
        for rows in shaped.groups(a, b):
            far = C.group_distances([a[r] for r in rows], [b[r] for r in rows])
            for n, r in enumerate(rows):
                for name, one in C.DISTANCES.items():
                    assert abs(far[name][n] - one(a[r], b[r])) < 1e-9, (name, docs[r], docs[::-1][r])


def test_compare_all_of_texts_is_that_of_trees(spark):
    docs = documents(3, 30)
    rows = [(i, d, i + 1, e) for i, (d, e) in enumerate(zip(docs, docs[1:]))]
    texts = spark.createDataFrame(rows, "a_id long, a string, b_id long, b string")
    got = {(r.a_id, r.method): r.similarity for r in C.compare_all(texts, read=N.read_texts("json")).collect()}
    for i, d, _, e in rows:
        both = C.Comparison(N.json_tree(d) or N.Tree(), N.json_tree(e) or N.Tree())
        assert all(abs(got[i, m] - both.likeness(m)) < 1e-9 for m in C.METHODS)
