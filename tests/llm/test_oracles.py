"""Queries with SQL against DuckDB on the driver's tables."""

import os
import random
from pathlib import Path

import duckdb
import pytest

from stowage.llm import oracles, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    got = queries.queries()[name](spark, SF)
    want = con.execute(oracles.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    mine = sorted((tuple(r) for r in got.select(*columns).collect()), key=str)
    assert mine == sorted(want.fetchall(), key=str) and mine


def test_propagation_over_links(spark, tmp_path):
    """The given tables have no links between hosts: the rounds' SQL on a table that has."""
    rng = random.Random(2)
    hosts = [f"h{k}.io" for k in range(60)] + ["a.org", "b.net", "c.example.com", "Example.NET"]
    rows = []
    for k in range(400):
        own = rng.choice(hosts)
        to = ["b.net", *hosts[:2]] if own in hosts[:10] else hosts
        links = "".join(f'<a id=x HREF=\'http://{rng.choice(to).upper()}/p?q\'>y</a><a data-href="//no.io">' for _ in range(rng.randrange(4)))
        rows.append((k, f"https://{own}/{rng.choice(['fr', 'de', 'en', ''])}/{k}", rng.choice([links, links, None])))
    spark.createDataFrame([*rows, (400, None, None), (7, "no scheme", "x")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = queries.op1_link_propagation(spark, str(tmp_path))
    want = con.execute(oracles.SQL["op1_link_propagation"])
    columns = [c[0] for c in want.description]
    mine = sorted((tuple(r) for r in got.select(*columns).collect()), key=str)
    assert mine == sorted(want.fetchall(), key=str)
    assert {r[-1] for r in mine if r[3] is None} == {"allow", "block"}
