"""Cleaners, compositions, numeric fields and the sweep, against values worked out by hand and plain recomputation."""

import json
from bisect import bisect_left, bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.functions import schema as S
from treeloom.functions import sections as C
from treeloom.operators import evaluate as E
from treeloom.operators import fields as D
from treeloom.operators import linkage as L


def one(spark, make, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("out")).first()["out"]


@pytest.mark.parametrize("key, name", [("Religion (2020)", "Religion"), ("religion", "Religions"), ("GDP  ( PPP )", "GDP (PPP)"), ("gdp ppp", "GDP PPP"), ("Ethnicity", "Ethnic Groups"), (" Some  key ", "Some key"), ("Countries (non x", "Countries (non-sovereign parts)"), ("", ""), (None, None)])
def test_canonical_key(spark, key, name):
    assert one(spark, S.canonical_key, key) == name


@pytest.mark.parametrize("value, want", [
    ("German, French and Italian (official); Romansh", dict.fromkeys(["German", "French", "Italian", "Romansh"], "present")),
    ("Swiss German / German", {"Swiss German": "present"}),
    ("German 62.6%, French 22.9% and others", {"German": "62.6%", "French": "22.9%"}),
    (json.dumps({"Pashto (main)": "48%", "( )": "x"}), {"Pashto": "48%"}),
    (json.dumps(["English", {"Dutch": "5%"}, "English or Frisian"]), {"English": "present", "Dutch": "5%", "Frisian": "present"}),
    ("", {}), (None, {}), ("and, or", {}),
])
def test_language_composition(spark, value, want):
    assert one(spark, S.language_composition, value) == want


@pytest.mark.parametrize("value, want", [
    (json.dumps({"Catholic": "30%", "Other Christians": "5.5%", "Sunni": 10, "Christianity": "40%", "Folk": "none"}), {"Christianity": "40.0%", "Islam": "10.0%"}),
    ("Catholic 20%; Protestant 30% / Irreligion 5%, Druze negligible", {"Christianity": "50.0%", "No religion": "5.0%", "Other": "0.0%"}),
    (None, {}), ("", {}),
])
def test_religion_composition(spark, value, want):
    assert one(spark, S.religion_composition, value) == want


def test_population_composition_and_roles(spark):
    assert one(spark, S.population_composition, "Malay, Chinese and Indian") == dict.fromkeys(["Malay", "Chinese", "Indian"], "present")
    assert one(spark, S.population_composition, json.dumps([{"A": "1%"}, " b  c "])) == {"A": "1%", "b c": "present"}
    assert one(spark, S.legislature_roles, "Senate, House of  Commons") == {"Legislature": "Senate, House of Commons", "Upper house": "Senate", "Lower house": "Senate, House of Commons"}
    assert one(spark, S.legislature_roles, "Diet") == {"Legislature": "Diet"}


def test_sections_by_schema(spark):
    got = one(spark, S.government_fields, {"Legislature": "Senate", "Upper house": "Lords", "government type": "x"}, S.TEXT_MAP)
    assert got == {"Legislature": "Senate", "Upper house": "Lords", "Government type": "x"}
    box = {"Official language": "Dari", "Largest city": "B", "Capital and largest city": "A", "Religion (2020)": "Sunni 9%", "Population composition": "C"}
    got = one(spark, S.general_fields, box, S.TEXT_MAP).asDict()
    assert got == {"fields": {"Capital": "A"}, "languages": {"Official": {"Dari": "present"}}, "population": {"C": "present"}, "religion": {"Islam": "9.0%"}}
    assert one(spark, S.general_fields, None, S.TEXT_MAP)["religion"] is None


@pytest.mark.parametrize("make, text, want", [
    (S.money, "$1.5 billion (2nd)", 1.5e9), (S.money, "about 1,200", 1200.0), (S.money, "none", None),
    (S.share, "Negligible", 0.0), (S.share, "-3.5 %", -3.5), (S.per_km, "in 2020: 62.5/km2", 62.5), (S.per_km, "rank 7", 7.0),
    (S.head_count, "37–39 million", 37e6), (S.head_count, "1.4 billion", 1.4e9), (S.head_count, "5,000 (est)", 5000.0), (S.head_count, None, None),
])
def test_numbers(spark, make, text, want):
    assert one(spark, make, text) == want


@pytest.mark.parametrize("path, text, field, number", [
    (["Area", "Total_km2"], "1,000 km", "area_total", 1000.0),
    (["Population", "2022 estimate"], "2 million", "population", 2e6),
    (["Population", "Density"], "5/km2", "density", 5.0),
    (["Economy", "HDI"], "0.9 very high", "hdi", 0.9),
    (["GDP (PPP)", "Per capita"], "$9,000", "gdp_per_capita", 9000.0),
    (["Religion", "Islam"], "none", None, None),
    (["Codes", "item"], "-12.5", "auto::codes / item", -12.5),
    (["Codes", "item"], "12 a", None, None),
    ([], "12", None, None),
])
def test_numeric_field(spark, path, text, field, number):
    row = D.with_fields(spark.createDataFrame([(1, path, text)], "id int, path array<string>, value string")).first()
    assert (row["field"], row["number"]) == (field, number)


def test_infobox(spark):
    box = {
        "Area": {"Water (%)": "n/a", "Land": "650 km2 (3rd)"},
        "Population": {"2010 census": "5", "2021 estimate": "10-12 million", "2021 rank": '{"a":"1"}', "Density": "40.5/km2"},
        "Economy": {"GDP (nominal)": '{"Total":"$350 million","Per capita":"1,2","Details":"in 2019"}', "Gini": "50 high", "Currency": "Euro"},
        "General": {"Administrative capital": "X 1° N", "Largest city": "Y Country: Z", "Ethnic groups (2020)": "See below", "Religion": '{"A":"5%","B":{"percentage":"6.5%"}}'},
        "Government": {"Government": "Republic", "Founded": '["1 May 1900","2 May 1901"]', "Head": "N"},
        "Independence day": {"Founded": "2000", "Split": "1950"},
    }
    c = one(spark, C.clean_infobox, box, "map<string,map<string,string>>").asDict(True)
    assert c["area"] == {"rank": 3, "total_km2": 650.0, "water_pct": 0.0}
    assert c["population"] == {"density_per_km2": 40.5, "total": 11000000, "year": 2021}
    assert c["economy"]["gdp_nominal"] == {"per_capita_usd": 12, "total_billion_usd": 0.35, "year": 2019}
    assert c["economy"]["gini"] == {"category": "high", "value": 50.0, "year": None} and c["economy"]["currency_code"] == "Euro"
    assert (c["general"]["capital"], c["general"]["largest_city"], c["general"]["ethnic_groups"]["note"]) == ("X", "Y", "See below")
    assert c["general"]["religion"]["groups"] == {"A": 5.0, "B": 6.5}
    assert c["government"]["leaders"] == {"head": "N"} and c["history"] == {"Founded": '["1 May 1900","2 May 1901"]', "Split": "1950"}
    empty = one(spark, C.clean_infobox, {}, "map<string,map<string,string>>").asDict(True)
    assert empty["area"]["total_km2"] is None and empty["history"] == {} and empty["time"]["timezone_utc"] is None


def test_normalised_against_sorting(spark):
    rng = np.random.default_rng(3)
    numbers = [float(x) for x in rng.integers(0, 40, 300)]
    docs = [(i, json.dumps({"m": {"v": n, "w": [None, "T  x"]}, "HDI": "1.5", "Gini": "25 low"})) for i, n in enumerate(numbers)] + [(900, None), (901, "no json"), (902, "{}")]
    rows = D.normalised(D.json_leaves(spark.createDataFrame(docs, "id long, text string").repartition(4), "id", "text")).collect()
    order = sorted(numbers)
    want = {i: min(1.0, (bisect_left(order, n) + bisect_right(order, n)) / 2 / (len(order) - 1)) for i, n in enumerate(numbers)}
    assert {r["id"]: r["norm"] for r in rows if r["field"] == "auto::m / v"} == {i: f"{x:.12f}" for i, x in want.items()}
    assert {(r["field"], r["norm"]) for r in rows if r["path"] == ["HDI"] or r["path"] == ["Gini"]} == {("hdi", "1.000000000000"), ("gini", "0.250000000000")}
    assert {r["norm"] for r in rows if r["kind"] == "text"} == {"null", "t x"} and len(rows) == 5 * len(numbers)


def test_labels_and_metrics(spark):
    docs = [(1, '{"A":{"x":1,"y":null},"B":{"x":[{"y":2}]}}'), (2, '{"A":{"y":3},"C":4}')]
    leaves = D.json_leaves(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    assert sorted((r["id"], r["path"]) for r in D.pruned(leaves, ["y"]).collect()) == [(1, ["A", "x"]), (2, ["C"])]
    assert D.pruned(leaves, []).count() == 5
    assert D.pruned_sections(leaves, ["a", "zz"], {"a": "A"}).count() == 2
    assert D.excluded_labels({"A": {"x": False, "y": False}, "B": {"x": True, "z": False}, "C": {}}) == ["A", "z"]
    tree = D.metric_tree(leaves)
    assert [tuple(r) for r in tree.orderBy("id", "place").collect()] == [(1, "A", "x", "1", 1), (1, "A", "y", "0", 2), (2, "A", "y", "3", 1)]
    assert D.with_metrics(tree, []).count() == 3 and D.with_metrics(tree, ["x"]).count() == 1
    pair = spark.createDataFrame([(1, 2)], "a_id long, b_id long")
    assert [tuple(r) for r in D.common_metrics(pair, tree).collect()] == [(1, 2, "A", "y")]


def test_sweep(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(24, 3)) + np.repeat(np.eye(3) * 6, 8, axis=0)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(24) for j in range(24) if i != j], "a_id long, b_id long, dist double")
    cuts = L.cuts(pairs, [1, 3, 4, 99])
    label = {}
    for r in cuts.collect():
        label.setdefault(r["k"], {})[r["id"]] = r["cluster"]
    assert sorted(label) == [1, 3, 4]
    assert label[4] == {r["id"]: r["cluster"] for r in L.cut(pairs, k=4).collect()}
    sweep = E.k_sweep(pairs, cuts)
    got = {r["k"]: r for r in sweep.collect()}
    for k in (3, 4):
        of = np.array([label[k][i] for i in range(24)])
        s = []
        for i in range(24):
            own = (of == of[i]) & (np.arange(24) != i)
            other = min(d[i, of == c].mean() for c in set(of) - {of[i]})
            s.append((other - d[i, own].mean()) / max(other, d[i, own].mean()) if own.any() else 0)
        assert got[k]["silhouette"] == pytest.approx(np.mean(s)) and got[k]["n_clusters"] == k
    assert got[1]["silhouette"] is None and E.best_k(sweep).first()["k"] == 3
