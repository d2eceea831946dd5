"""A few queries against their SQL, and the entry module without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def cells(rows):
    return sorted(tuple(repr(v + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["nation_ted_matrix", "leaf_numeric_cost", "doc_vector_measures", "diff_ops", "silhouette", "dbscan", "quantile_midrank", "weighted_ted", "weighted_ted_script", "matrix_slice", "ted_norms", "part_value_ops", "contained_items", "url_spectral_likeness"])
def test_query_matches_sql(spark, name):
    from treeloom.plans import registry

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got = registry.QUERIES[name](spark, str(DATA))
    want = con.execute(registry.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert cells(got.select(*[f"`{c}`" for c in names]).collect()) == cells(want.fetchall())


def test_entry_imports_without_the_optional_subpackage():
    code = "import sys; sys.modules['treeloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
