"""Every registered core query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from triloom import queries as core

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in DATA.iterdir():
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_matches_sql(spark, db, name):
    df = core.queries()[name](spark, str(DATA))
    cur = db.execute(core.oracle_sql()[name])
    names = sorted(d[0] for d in cur.description)
    assert sorted(df.columns) == names
    at = [[d[0] for d in cur.description].index(n) for n in names]
    fix = lambda v: round(v, 3) if isinstance(v, float) else v
    expected = sorted((tuple(fix(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(fix(r[n]) for n in names) for r in df.collect()), key=repr) == expected


def test_star_is_one_scan(spark):
    plan = core.case("bgp_star")(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def plan_of(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    df = core.case(name)(spark, str(DATA))
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_filters_are_pushed_down(spark):
    assert "LessThan(c_acctbal,100.5)" in plan_of(spark, "filter_number_pushed") and "EqualTo(c_nationkey,4)" in plan_of(spark, "filter_number_pushed")
    assert "LessThan(c_acctbal,100.5)" in plan_of(spark, "filter_lt_num") and "EqualTo(c_nationkey,4)" in plan_of(spark, "filter_eq_iri")
    assert "GreaterThanOrEqual(l_quantity,40" in plan_of(spark, "filter_ge_num")


def test_variable_predicate_is_one_scan(spark):
    assert plan_of(spark, "pattern_bound_s").count("FileScan") == 1
    assert plan_of(spark, "bgp_star_bound_objects").count("FileScan") == 2


def test_variables_read_only_tables_that_they_can_name(spark):
    plan = plan_of(spark, "bgp_two_shared_vars")
    assert plan.count("FileScan") == 3 and "explode" not in plan and "concat(<urn:customer" not in plan.split("Join", 1)[1]


def test_joins_by_stored_keys(spark):
    plan = plan_of(spark, "bgp_path")
    assert "concat(<urn:nation" not in plan


def test_counted_side_is_broadcast(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # so that only the engine's own choice shows
    try:
        assert "BroadcastHashJoin" in plan_of(spark, "join_broadcast")
        assert "__salt" in plan_of(spark, "join_skew")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_bound_object_is_pushed_down(spark):
    plan = core.case("pattern_bound_o")(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan
