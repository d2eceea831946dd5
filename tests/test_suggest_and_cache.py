"""Name suggestions against all pairs, and a matrix cache with names added, dropped and changed."""

import difflib
import random

from pyspark.sql import functions as F

from treeloom.operators import suggest
from treeloom.sources import matrix_cache


def test_suggestions_against_all_pairs(spark):
    rng = random.Random(4)
    known = sorted({"".join(rng.choices("abcdefgh ", k=rng.randint(2, 12))).strip() or "a" for _ in range(150)}) + ["mississippi", "aaaaab"]
    asked = [w[:2] + w[3:] for w in known[::5]] + ["misisipi", "zzz", "", "baaaaa", known[3], None]
    k, c = (spark.createDataFrame([(w,) for w in ws], "key string") for ws in (asked, [*known, None, known[0]]))
    got = {}
    for r in suggest.close_names(k, c).collect():
        got.setdefault(r.key, []).append((r.rank, r.match))
    want = {}
    for a in {*asked} - {*known, "", None}:
        if found := difflib.get_close_matches(a, known, n=5, cutoff=0.6):
            want[a] = list(enumerate(found, 1))
    assert {a: sorted(m) for a, m in got.items()} == want and len(want) > 20


def test_cache_computes_only_new_pairs(spark, tmp_path):
    path, asked = str(tmp_path / "cache"), []

    def measure(pairs):
        asked.append(pairs.count())
        return pairs.select("a_id", "b_id", F.abs(F.col("a.x") - F.col("b.x")).alias("dist"))

    def docs(values):
        return spark.createDataFrame([(i, (float(x),)) for i, x in values.items()], "id long, doc struct<x:double>")

    def check(values):
        got = {(r.a_id, r.b_id): r.dist for r in matrix_cache.upkeep(docs(values), path, measure).collect()}
        assert got == {(a, b): abs(values[a] - values[b]) for a in values for b in values if a < b}

    values = {i: i * i for i in range(8)}
    check(values)
    check(values)  # valid as it is
    assert asked == [28] and matrix_cache.versions(spark, path) == [0]
    values = {i: x for i, x in values.items() if i != 3} | {20: 5, -1: 7}
    check(values)  # one dropped, two added
    assert asked == [28, 7 * 2 + 1]
    check(values | {0: 100})  # one changed
    assert asked[-1] == 8 and matrix_cache.versions(spark, path) == [0, 1, 2]
    (tmp_path / "cache" / "version=2" / "names" / "_SUCCESS").unlink()
    assert matrix_cache.versions(spark, path) == [0, 1]  # one that was not written to its end does not count
