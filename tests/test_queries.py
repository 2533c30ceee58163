"""Every query with SQL gives the rows that DuckDB gives; every other one runs."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from stowage.plans import queries as plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df: pd.DataFrame) -> list:
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple("~" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else str(v.item() if hasattr(v, "item") else v) for v in r))
    return sorted(out)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    got = plans.queries()[name](spark, SF)
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert got.count() >= 0
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    mine = pd.DataFrame([tuple(r) for r in got.collect()], columns=got.columns, dtype=object)
    assert len(mine) == len(want) and len(mine) > 0
    assert rows(mine) == rows(want.astype(object))


def test_contract(spark):
    names = set(__spark_entry__.queries())
    assert set(plans.queries()) <= names and set(__spark_entry__.oracle_sql()) <= names
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_optional_parts(tmp_path, pipeline):
    """A real copy without the subpackage, with and without the pipeline's file, in a process of its own."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "stowage", tmp_path / "stowage", ignore=shutil.ignore_patterns("llm"))
    (tmp_path / "stowage/llm/__pycache__").mkdir(parents=True)
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (root / "corpus_pipeline.py").exists() else [])]:
        shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert said.stdout.splitlines()[0].split() == sorted(plans.queries()), said.stderr
    assert said.stdout.splitlines()[1].split() == sorted(plans.oracle_sql())
