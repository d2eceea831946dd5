"""Each reader and writer of documents, written and read again."""

import json

import pytest
from pyspark.sql import functions as F

from treeloom.sources import documents as S


def doc(name, **over):
    return {"country": name, "area": {"total_km2": 10.5, "water_pct": 2.0, "rank": 3}, "general": {"capital": " C ", "religion": {"groups": {"A": 60.0, "B": 40, "C": {"percentage": 1}, "D": None}, "year": 2020}}, "history": {"z": "1", "a": "2"}, "population": {"total": 7, "density_per_km2": 0.5}, "economy": {"hdi": {"value": 0.9}, "gini": {"value": 30.5}}} | over


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "docs"
    at.mkdir()
    (at / "Alpha.json").write_text(json.dumps(doc("Alpha")))
    (at / "Beta_Land.json").write_bytes(b"\xef\xbb\xbf" + json.dumps({k: v for k, v in doc("x").items() if k != "country"}).encode())
    (at / "Broken.json").write_text('{"country": "Bro')
    return at


def test_directory(spark, folder):
    rows = {r.country: r for r in S.read_directory(spark, str(folder)).collect()}
    assert set(rows) == {"Alpha", "Beta Land"}
    assert rows["Alpha"].area.total_km2 == 10.5 and rows["Alpha"].history == {"z": "1", "a": "2"}


def test_unreadable_files_are_named(spark, folder):
    assert [r.file for r in S.unreadable(spark, str(folder)).collect()] == ["Broken.json"]


@pytest.mark.parametrize("form", ["wrapped", "list", "single", "infobox", "directory"])
def test_documents_of_any_form(spark, tmp_path, form):
    docs = [doc("Alpha"), doc("Beta")]
    boxed = [{"country": d["country"], "url": "u", "infobox": {k: v for k, v in d.items() if k != "country"}} for d in docs]
    if form == "directory":
        for d in docs:
            (tmp_path / f"{d['country']}.json").write_text(json.dumps(d))
        path = tmp_path
    else:
        path = tmp_path / "all.json"
        path.write_text(json.dumps(indent=None if form == "list" else 2, obj={"wrapped": {"countries": [*docs, None, 3]}, "list": docs, "single": docs[0], "infobox": {"countries": boxed}}[form]))
    got = {r.country: json.loads(r.json) for r in S.read_any(spark, str(path)).collect()}
    want = {d["country"]: {k: v for k, v in d.items() if k != "country"} for d in (docs[:1] if form == "single" else docs)}
    assert got == want


def test_wrapped_and_last_of_each(spark, tmp_path):
    path = tmp_path / "all.json"
    path.write_text(json.dumps({"countries": [doc("A"), doc("B"), doc("A", population={"total": 9, "density_per_km2": 1.0})]}))
    rows = S.read_wrapped(spark, str(path))
    assert rows.count() == 3
    last = {r.country: r.population.total for r in S.last_of_each(rows.withColumn("n", F.col("population.total")), "country", "n").collect()}
    assert last == {"A": 9, "B": 7}


def test_labels(spark, tmp_path):
    (tmp_path / "labels.txt").write_text("# comment\nAlpha\tEurope, West\n\nBeta,Asia\nGamma\n")
    assert {tuple(r) for r in S.read_labels(spark, str(tmp_path / "labels.txt")).collect()} == {("Alpha", "Europe, West"), ("Beta", "Asia")}


def test_leaves_and_flat_table(spark, folder, tmp_path):
    docs = S.read_directory(spark, str(folder))
    leaf = S.leaves(docs).filter("country = 'Alpha'").first().doc
    assert leaf.capital == "C" and leaf.history == "a | z" and leaf.religion == {"A": 60.0, "B": 40.0} and leaf.gini == 30.5 and leaf.demonym == ""
    S.write_flat(docs, str(tmp_path / "flat"))
    flat = {r.country: r for r in spark.read.option("header", True).csv(str(tmp_path / "flat")).collect()}
    assert flat["Alpha"].top_religion == "A" and float(flat["Alpha"].hdi) == 0.9


def test_matrix_table(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "a", 0.0), ("a", "b", 0.25), ("b", "a", 0.25), ("b", "b", 0.0)], "a_id string, b_id string, dist double")
    S.write_matrix(pairs, str(tmp_path / "m"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "m")).orderBy("a_id").collect()
    assert [tuple(r) for r in rows] == [("a", "0.000000", "0.250000"), ("b", "0.250000", "0.000000")]


def test_json_and_text_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("Alpha", '{"a": 1}', "line 1\nline 2"), ("Be/ta", '{"b": [1, 2]}', "x")], "name string, json string, text string")
    S.write_json(rows, str(tmp_path / "json"), "name", "json")
    back = S.read_any(spark, str(tmp_path / "json"), name="name")
    assert {r.name: json.loads(r.json) for r in back.collect()} == {"Alpha": {"a": 1}, "Be/ta": {"b": [1, 2]}}
    S.write_texts(rows, str(tmp_path / "text"), "name", "text")
    assert {(r.name, r.text.rstrip("\n")) for r in spark.read.schema("text string, name string").text(str(tmp_path / "text"), wholetext=True).collect()} == {("Alpha", "line 1\nline 2"), ("Be/ta", "x")}


def test_cluster_and_patch_sinks(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, -1)], "id long, cluster long")
    S.write_clusters(labels, {"algorithm": "dbscan", "eps": 0.1}, str(tmp_path / "c"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c" / "labels")).orderBy("id").collect()] == [("1", "1"), ("2", "1"), ("3", "-1")]
    report = spark.read.json(str(tmp_path / "c" / "report")).first()
    assert (report.algorithm, report.documents, report.clusters, report.noise) == ("dbscan", 3, 1, 1)
    docs = spark.createDataFrame([(1, '{"a": 1}', '{"a": 2, "b": 3}')], "pair long, s string, t string")
    S.write_patches(docs.select("pair", F.col("s").alias("json")), docs.select("pair", F.col("t").alias("json")), str(tmp_path / "p"))
    got = {name: spark.read.json(str(tmp_path / "p" / name)).collect() for name in ("source", "target", "patched", "edit_script")}
    assert json.loads(got["patched"][0].json) == json.loads(got["target"][0].json) == {"a": 2.0, "b": 3.0}
    assert [(r.op, r.path) for r in sorted(got["edit_script"], key=lambda r: r.seq)] == [("update", ["a"]), ("insert", ["b"])]
