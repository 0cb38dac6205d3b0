"""Every query of the subpackage that SQL can express, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from triloom.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for f in DATA.iterdir():
        db.execute(f"create view {f.stem} as select * from '{f}'")
    cur = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    expected = sorted(repr(sorted(zip(names, r, strict=True))) for r in cur.fetchall())
    got = queries.queries()[name](spark, str(DATA)).collect()
    assert sorted(repr(sorted(r.asDict().items())) for r in got) == expected
