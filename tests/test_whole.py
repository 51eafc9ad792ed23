"""Queries over whole tables, against their SQL without the conditions that leave rows out."""

import pytest

from rampart import catalog
from tests.oracle import check, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def whole(name, *changes):
    """The SQL of a query with pieces replaced; pieces that aren't there any more are no matter."""
    sql = catalog.ORACLE[name]
    for old, new in changes:
        sql = sql.replace(old, new)
    return sql


ZONES = (" and zone_level = 0", "")


@pytest.mark.parametrize("name", ["public_endpoints", "pii_paths_from_public"])
def test_public_endpoints_of_every_zone_count(spark, con, name):
    check(catalog.QUERIES[name](spark, SF), con, whole(name, ZONES))


def test_no_finding_is_left_out_by_its_number(spark, con):
    check(catalog.QUERIES["public_paths_to_finding_topk"](spark, SF), con, whole("public_paths_to_finding_topk", ZONES, (" where f % 7 = 0", "")))


def test_dataflow_of_each_endpoint_reads_and_writes(spark, con):
    every = whole("trace_dataflow", ZONES, (" where access = 'write'", ""), (" order by hops, ep, ds, path limit 20", ""), ("select distinct ep, ds", "select * from (select distinct ep, ds"))
    check(catalog.QUERIES["trace_dataflow"](spark, SF), con, every + ") qualify row_number() over (partition by ep order by hops, ds, path) <= 20")


def test_all_parts_meet_all_lines(spark, con):
    check(catalog.QUERIES["truth_match"](spark, SF), con, whole("truth_match", (" where p_partkey % 20 = 0", ""), (" where l_orderkey % 40 = 0", "")))


def test_every_fiftieth_vector_is_asked(spark, con):
    check(catalog.QUERIES["dense_topk"](spark, SF), con, whole("dense_topk", ("vec_id < 40", "vec_id % 50 = 0")))


@pytest.mark.parametrize("name", ["rrf_fusion", "exact_or_fallback_lookup"])
def test_items_from_40_on_have_a_dense_half(spark, tmp_path, name):
    from tests.oracle import TABLES

    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    (tmp_path / "benchmark.parquet").unlink()
    spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id < 6").selectExpr("item_id + 37 as item_id", "text").toPandas().to_parquet(tmp_path / "benchmark.parquet")
    check(catalog.QUERIES[name](spark, str(tmp_path)), connect(str(tmp_path)), whole(name, ("vec_id < 40", "vec_id in (select item_id from benchmark)")))


def test_events_in_part_files_are_streamed(spark, con, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    check(catalog.QUERIES["stream_events_to_snapshots"](spark, str(tmp_path)), con, whole("stream_events_to_snapshots"))
