import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
QUICK = ["edge_triplets", "degrees", "edge_time", "phev_energy", "bev_soc_fold", "vehicle_restriction", "grid_search", "nearest_vertex", "route_edges", "route_wkt", "kernel_cost", "iteration_limit", "similarity_weighted", "price_parse"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in con.description]
    want = [dict(zip(names, row, strict=True)) for row in con.fetchall()]
    got = __spark_entry__.queries()[name](spark, SF).toArrow().to_pylist()
    key = lambda r: str(sorted(r.items()))
    assert len(got) == len(want) and sorted(got, key=key) == sorted(want, key=key)


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_imports_without_the_llm_subpackage(tmp_path):
    import shutil

    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "wayfold", tmp_path / "wayfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'sssp_cost' in e.queries() and not any(k.startswith('op1_') or k == 'pipeline' for k in e.queries()); assert e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}).returncode == 0
