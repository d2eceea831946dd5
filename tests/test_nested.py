"""Trees of any JSON or markup, recursive distances with script and replay, nested diff, comparison, containment."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.operators import compare as C
from treeloom.operators import nested as N
from treeloom.operators import nested_diff as D
from treeloom.operators import recursive as R
from treeloom.operators import weighted as W


def some_value(rng, depth=0):
    draw = rng.random()
    if depth < 4 and draw < 0.55:
        return {rng.choice(["alpha", "beta", "gamma", "Area", "two words", "a/b"]): some_value(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if depth < 4 and draw < 0.65:
        return [some_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, 2.5, -0.3, "x", "some  text", "", None, True, "A b"])


def some_documents(seed, n):
    rng = random.Random(seed)
    return [{"r": some_value(rng), **({"q": some_value(rng)} if rng.random() < 0.7 else {})} for _ in range(n)]


def nested(tree, i=None, kids=None):
    """(label, content, children) of a tree, for plain recursions."""
    i, kids = (len(tree) - 1, tree.children()) if kids is None else (i, kids)
    return tree.labels[i], (tree.kinds[i], tree.numbers[i], tree.texts[i]), tuple(nested(tree, k, kids) for k in kids[i])


def size(t):
    return 1 + sum(map(size, t[2]))


def test_json_trees_hold_the_document(spark):
    docs = some_documents(1, 30)
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(30, None), (31, "{broken"), (32, "﻿{\"a\": 1}"), (33, "[]"), (34, '"text"'), (35, "{}")]
    trees = N.trees(spark.createDataFrame(rows, "id long, json string"), "id", "json")
    back = {r.id: r.text for r in N.rendered(trees).collect()}

    def held(v):
        if isinstance(v, list):
            return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in v]
        return {k: held(x) for k, x in v.items()} if isinstance(v, dict) else N.plain_value(v)

    assert all(json.loads(back[i]) == held(d) for i, d in enumerate(docs))
    assert back[30] is None and back[31] is None and json.loads(back[32]) == {"a": 1.0} and json.loads(back[33]) == [] and json.loads(back[35]) == {}
    assert N.trees(spark.createDataFrame([], "id long, json string"), "id", "json").count() == 0


def test_canonical_trees_and_their_distances(spark):
    from treeloom.sources import documents as S

    def doc(name, **over):
        base = {"country": name, "area": {"total_km2": 100.0, "water_pct": 1.0, "rank": None}, "codes": {"calling_code": "+1"}, "economy": {"currency_code": "X", "gdp_ppp": {"total_billion_usd": 10.0, "per_capita_usd": 5}, "gini": {"value": None}}, "general": {"capital": "C", "religion": {"groups": {"A": 50, "B": {"percentage": 1}}}}, "government": {"type": "Federal republic"}, "history": {"b": "1", "a": "2"}, "population": {"total": 7}, "time": {}}
        return json.dumps(base | over)

    rows = [(doc("P"),), (doc("Q", government={"type": "Federal presidential republic"}, area={"total_km2": 1000.0, "water_pct": 1.0, "rank": None}),)]
    docs = spark.createDataFrame(rows, "json string").select(F.from_json("json", S.CANONICAL).alias("d")).select("d.*")
    trees = N.canonical_trees(S.leaves(docs))
    by = {r.id: r.tree for r in trees.collect()}
    t = N.Tree.of(by["P"])
    assert len(t) == 37 and t.labels[-1] == "infobox" and t.labels.count("total_billion_usd") == 2 and sorted(t.children()[-1]) == t.children()[-1]
    pair = trees.alias("a").join(trees.alias("b"), F.expr("a.id = 'P' and b.id = 'Q'")).selectExpr("a.id a_id", "a.tree a", "b.id b_id", "b.tree b")
    got = W.distances(pair).first().distance
    smooth = lambda x: x * x * (3 - 2 * x)
    missing = 0.5 * (0.3 + 3.0 + 2.5 + 2.0 + 2.0 + 1.5)  # rank, nominal total and share, gini, hdi, density: absent on both sides
    assert got == pytest.approx(1.5 * smooth(0.5) + 1.5 * smooth(1 / 3) + missing)


def plain_recursive(a, b, c, depth=0):
    """The recursion over child lists, written without tables shared between nodes."""

    def same(x, y):
        if c.fuzzy:
            longest = max(len(x[0]), len(y[0]))
            like = 1 - R.letters_apart(x[0], y[0]) / longest if longest else 1.0
            one = like >= 1 - max(1, max(longest, 1) // 3) / max(longest, 1)
        else:
            one = x[0] == y[0]
        if not one:
            return False
        if x[1][0] == y[1][0] == "num":
            return math.isclose(x[1][1], y[1][1], abs_tol=1e-12)
        text = lambda k: f"{k[1]:.12f}" if k[0] == "num" else k[2] or ""
        return text(x[1]) == text(y[1])

    def inside(p, t):
        rest = iter(t[2])
        return same(p, t) and all(any(inside(k, x) for x in rest) for k in p[2])

    def anywhere(p, t):
        return inside(p, t) or any(anywhere(p, k) for k in t[2])

    whole = lambda p, t: c.moved if anywhere(p, t) else c.node * size(p)
    longest = max(len(a[0]), len(b[0]))
    gap = (R.letters_apart(a[0], b[0]) / longest if longest else 0.0) if c.fuzzy else float(a[0] != b[0])
    if c.fuzzy and gap > max(1, max(longest, 1) // 3) / max(longest, 1) + 1e-12:
        gap *= c.mismatch
    gap = gap / (1 + depth) if c.by_depth else gap
    if not a[2] and not b[2]:
        if a[1][0] == b[1][0] == "num":
            gap += c.number * max(0.0, abs(a[1][1] - b[1][1]) - c.tolerance)
        elif a[1][0] != b[1][0] or a[1][2] != b[1][2]:
            gap += c.text
    t = [[gap] + [0.0] * len(b[2]) for _ in range(len(a[2]) + 1)]
    for i in range(len(a[2]) + 1):
        for j in range(len(b[2]) + 1):
            if i or j:
                ways = []
                if i:
                    ways.append(t[i - 1][j] + whole(a[2][i - 1], b))
                if j:
                    ways.append(t[i][j - 1] + whole(b[2][j - 1], a))
                if i and j:
                    ways.append(t[i - 1][j - 1] + plain_recursive(a[2][i - 1], b[2][j - 1], c, depth + 1))
                t[i][j] = min(ways)
    return t[-1][-1]


def tree_pairs(spark, seed, n, form):
    docs = [json.dumps(d) for d in some_documents(seed, 2 * n)]
    rows = spark.createDataFrame([(i, docs[2 * i], docs[2 * i + 1]) for i in range(n)], "a_id long, x string, y string")
    a, b = N.trees(rows, "a_id", "x", form), N.trees(rows, "a_id", "y", form)
    return a.select(F.col("id").alias("a_id"), F.col("tree").alias("a")).join(b.select(F.col("id").alias("a_id"), (F.col("id") + 1000).alias("b_id"), F.col("tree").alias("b")), "a_id"), docs


@pytest.mark.parametrize("costs", [R.EARLY, R.Costs(section=1.0)])
def test_recursive_distance_script_and_replay(spark, costs):
    pairs, docs = tree_pairs(spark, 3, 40, "items")
    got = {r.a_id: r for r in R.distances(pairs, costs).collect()}
    plain = lambda d: (lambda t: (lambda n: n)(nested(t)))(N.json_tree(d, items=True))
    clean = lambda t: (N.plain_text(t[0]), t[1], tuple(map(clean, t[2])))
    for i in range(40):
        want = plain_recursive(clean(plain(docs[2 * i])), clean(plain(docs[2 * i + 1])), costs)
        assert got[i].distance == pytest.approx(want, abs=1e-9)
        assert 0 <= got[i].similarity <= 1
    ops = R.scripts(pairs, costs)
    cost = {r.a_id: r.cost for r in ops.groupBy("a_id").agg(F.sum("cost").alias("cost")).collect()}
    assert all(cost.get(i, 0.0) == pytest.approx(got[i].distance, abs=1e-6) for i in got)
    after = R.replayed(pairs, R.scripts(pairs, costs, complete=True), costs).collect()
    assert len(after) == 40 and all(r.equal and r.exact for r in after)
    sections = R.section_summary(ops).collect()
    assert sum(r.total_ops for r in sections) == ops.count() and all(r.total_ops == r.updates + r.inserts + r.deletes for r in sections)


def test_sections_and_paths():
    t = N.json_tree('{"Area": {"size": 1}, "x": {"Economy": {"y": 2}}}', items=True)
    assert dict(zip(t.labels, t.sections(R.SECTIONS), strict=True)) == {"size": "Area", "Area": "Area", "y": "Economy", "Economy": "Economy", "x": None, "root": None}
    assert R.path_steps("root/General[2]/a/b[1]") == [("General", 1), ("a/b", 0)] and R.path_steps("root") == []
    with pytest.raises(ValueError):
        R.path_steps("root/nothing")


def test_nested_diff_replays_in_order(spark):
    rng = random.Random(8)
    docs = some_documents(5, 60)
    rows = []
    for i in range(60):
        other = json.loads(json.dumps(docs[i]))
        other["new"] = some_value(rng)
        if rng.random() < 0.5:
            other = dict(sorted(other.items()))
        rows.append((i, json.dumps(docs[i]), json.dumps(other if i % 3 else docs[(i * 7) % 60])))
    df = spark.createDataFrame([*rows, (60, '{"a": 1}', "[1]"), (61, '{"a": {"b": 1}}', '{"a": 2}')], "pair long, s string, t string")
    s, t = df.select("pair", F.col("s").alias("json")), df.select("pair", F.col("t").alias("json"))
    ops = D.script(D.node_rows(s, "pair", "json"), D.node_rows(t, "pair", "json"))
    there = D.verified(D.apply_script(s, "pair", "json", ops), t, "pair", "json").collect()
    assert len(there) == 62 and all(r.equal for r in there)
    back = D.verified(D.apply_script(t, "pair", "json", D.invert(ops)), s, "pair", "json").collect()
    assert all(r.equal for r in back)
    kinds = {(r.pair, r.op, r.label, r.old_type, r.new_type) for r in ops.filter("pair >= 60").collect()}
    assert kinds == {(60, "update", "root", "dict", "list"), (61, "update", "a", "dict", "num")}
    steps = D.snapshots(s, "pair", "json", ops).groupBy("pair").agg(F.count("*").alias("n")).collect()
    n_ops = {r.pair: r.n for r in ops.groupBy("pair").agg(F.count("*").alias("n")).collect()}
    assert {r.pair: r.n - 1 for r in steps} == {i: n_ops.get(i, 0) for i in range(62)}
    assert D.script_lines(ops).filter("pair = 61").first().text == 'update root/a: {"b": 1.0} -> 2.0'


def test_distances_of_trees_against_recursions():
    rng = random.Random(2)
    for _ in range(40):
        a, b = (N.json_tree(json.dumps(d)) for d in some_documents(rng.random(), 2))
        la, lb = ([(x, t.depths[i]) for i in t.preorder() for x in [C.compared_labels(t)[i]]] for t in (a, b))
        d = np.zeros((len(la) + 1, len(lb) + 1))
        d[:, 0], d[0] = range(len(la) + 1), range(len(lb) + 1)
        for i, (x, p) in enumerate(la, 1):
            for j, (y, q) in enumerate(lb, 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (C.relabel_cost(x, y) if p == q else np.inf))
        assert C.sequence_distance(a, b) == pytest.approx(d[-1, -1])

        def inside(p, t):
            rest = iter(t[2])
            return p[0] == t[0] and all(any(inside(k, x) for x in rest) for k in p[2])

        def shown(t):
            kind, number, text = t[1]
            return t[0] if t[2] or (number is None and text is None) else text if number is None else str(number)

        def children(s, t):
            f = [[0.0] * (len(t[2]) + 1) for _ in range(len(s[2]) + 1)]
            for i in range(len(s[2]) + 1):
                for j in range(len(t[2]) + 1):
                    if i and j:
                        x, y = s[2][i - 1], t[2][j - 1]
                        f[i][j] = min(f[i - 1][j] + (1 if inside(x, t) else size(x)), f[i][j - 1] + (1 if inside(y, s) else size(y)), f[i - 1][j - 1] + children(x, y))
                    else:
                        f[i][j] = float(i + j)
            return f[-1][-1] + C.relabel_cost(shown(s), shown(t))

        assert C.children_distance(a, b) == pytest.approx(children(nested(a), nested(b)))
        assert C.forest_distance(a, a) == 0 and C.forest_distance(a, b) == pytest.approx(C.forest_distance(b, a))
        assert C.spectral_likeness(a, a) == pytest.approx(1.0)


def test_features_of_a_tree():
    t = N.markup_tree("<ul><li>a</li><li><b>c</b><br></li></ul>")
    assert C.tag_features(t) == ["root", "ul", "li", "li", "b", "br"]
    assert sorted(C.edge_features(t)) == ["li/b", "li/br", "root/ul", "ul/li", "ul/li"]
    assert C.root_path_features(t) == ["root/ul/li", "root/ul/li/b", "root/ul/li/br"]
    assert C.xpath_features(t) == ["ul[1]", "ul[1]/li[1]", "ul[1]/li[2]", "ul[1]/li[2]/b[1]", "ul[1]/li[2]/br[1]"]
    assert C.skeleton(t)[:4] == ["<root>", "<ul>", "<li>", "</li>"]
    assert C.label_script(list("abcd"), list("axce")) == [("update", "b", "x"), ("update", "d", "e")]
    assert [o for o, *_ in C.label_script(list("abc"), list("c"))] == ["delete", "delete"]


def test_compare_all_gives_every_method(spark):
    pairs, _ = tree_pairs(spark, 9, 6, "json")
    rows = C.compare_all(pairs).collect()
    assert len(rows) == 6 * len(C.METHODS) == 120 and all(0 <= r.similarity <= 1 for r in rows)
    self_pairs = pairs.selectExpr("a_id", "a", "a_id as b_id", "a as b")
    assert all(r.similarity == pytest.approx(1.0) for r in C.compare_all(self_pairs).collect())


@pytest.mark.parametrize("values", [False, True])
def test_inclusions_against_all_pairs(spark, values):
    docs = some_documents(12, 40)
    parts = [d["r"] for d in docs if isinstance(d["r"], dict)][:12] + [docs[0], {}]
    trees = N.trees(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(40, None)], "id long, json string"), "id", "json")
    whole = N.trees(spark.createDataFrame([(i, json.dumps({"r": p})) for i, p in enumerate(parts)], "id long, json string"), "id", "json")
    patterns = C.subtrees(whole, "r")
    got = {(r.pattern_id, r.id): r.nodes for r in C.inclusions(patterns, trees, values).collect()}
    want = {}
    for p in range(len(parts)):
        pt = N.json_tree(json.dumps(parts[p]), "r")
        for i, d in enumerate(docs):
            t = N.json_tree(json.dumps(d))
            pk, tk = pt.children(), t.children()
            at = [j for j in range(len(t)) if C.labels_contained(pt, len(pt) - 1, pk, t, j, tk, values)]
            if at:
                want[p, i] = at
    assert got == want and len(want) > 5
