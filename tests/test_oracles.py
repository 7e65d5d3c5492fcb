"""Every query of the engine beside its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from sightline.plans import registry
from tools.compare import rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = con.execute(registry.ORACLES[name])
    theirs = [d[0] for d in got.description]
    assert sorted(theirs) == cols
    order = [theirs.index(c) for c in cols]
    want, _ = rows_of([tuple(r[i] for i in order) for r in got.fetchall()], cols)
    mine, _ = rows_of([tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()], cols)
    assert mine == want and mine


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_without_oracle(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_hold_no_accidental_cartesian_product(spark):
    """Only the blocks of a matrix product and one-row tables are crossed."""
    for name in ("gate_join_binned", "iou_self_join", "negative_pairs_hash", "prior_merge", "dedup_adjacent", "dist_chi2"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_civil_time_of_any_year(spark, tmp_path, zone):
    """Years of five and six digits, years before 0, and hours that the session's zone skips."""
    ids = [0, 1, -1, 99999, 2934540, 2934541, 2934542, 5999999, 11600000, 100000000, -719520, -719600, -1000000, 13232, 13233, None, *range(13000, 13400)]
    path = f"{tmp_path}/events.parquet"
    duckdb.sql(f"COPY (SELECT unnest({[i for i in ids if i is not None]}::BIGINT[] || [NULL]) AS event_id) TO '{path}' (FORMAT parquet)")
    want = duckdb.sql(registry.ORACLES["civil_time"].replace("FROM events", f"FROM '{path}'")).fetchall()
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = registry.QUERIES["civil_time"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) == len(ids)
