"""Every query against its SQL, and the driver's contract."""

import pytest

import __spark_entry__ as entry
from tidemark.plans.catalogue import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, sf_dir, same):
    same(QUERIES[name](spark, sf_dir), ORACLE[name])


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 7 and [r.at_ms for r in rows] == sorted(r.at_ms for r in rows)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Shanghai"])
def test_results_do_not_follow_the_session_zone(zone, spark, sf_dir, same):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for name in ("daily_stats", "weekly_stats", "last7days", "csv_export_rows", "today_ms"):
            same(QUERIES[name](spark, sf_dir), ORACLE[name])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_day_filter_reaches_the_scan(spark, sf_dir):
    from tidemark.sources import tables

    plan = tables.sessions(tables.read(spark, sf_dir, "events"), since_ms=1_706_572_800_000)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "props" not in plan.split("ReadSchema")[1]
