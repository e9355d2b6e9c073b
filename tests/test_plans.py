"""Shape of the physical plans, and spread of the work under skew."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandlens.catalog import ORACLE, QUERIES
from strandlens.functions.timing import bucket
from strandlens.operators import intervals as I
from strandlens.operators import ordered as O
from strandlens.operators import windows as W
from strandlens.operators.quantiles import quantiles

SF = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not SF.exists(), reason="driver tables are absent")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_checked_query_is_registered():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)


@needs_data
@pytest.mark.parametrize(
    "name",
    [
        "join_casting", "join_casting_unkeyed", "classify_gaps", "casting_coverage", "gap_overlap_semi",
        "points_in_castings", "sequence_detail", "join_logs", "gap_ecdf", "category_profile", "width_effect",
    ],
)
def test_no_nested_loops(spark, name):
    text = plan(QUERIES[name](spark, str(SF)))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["filter_process"](spark, str(SF)))
    assert "GreaterThanOrEqual(value,0.5)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(QUERIES["density_2d"](spark, str(SF)))).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"l_quantity", "l_extendedprice"}


def skewed(spark, n=40_000):
    """Nine rows out of ten belong to one series."""
    return spark.range(n).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(-1).cast("string").alias("strand"),
        F.expr("timestamp_ntz'2025-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 30)").alias("ts"),
        "id",
        F.rand(1).alias("v"),
    )


def largest_task_share(df) -> float:
    parts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    counts = [r.n for r in parts.collect()]
    return max(counts) / sum(counts)


@pytest.fixture
def many_partitions(spark):
    names = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n) for n in names}
    for name, value in zip(names, ("false", "16", "-1")):
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_one_hot_series_is_spread_over_tasks(spark, many_partitions):
    df = skewed(spark)
    chunk = bucket("ts", 3_600)
    placed = O.scan(df, ["strand"], ["ts", "id"], chunk, lag={"prev": "ts"}, position="pos")
    assert largest_task_share(placed) < 0.2
    blocks = O.halo_blocks(O.finish(placed), "pos", 500, after=3).repartition(16, "strand", O.BLOCK)
    assert largest_task_share(blocks) < 0.2
    castings = df.groupBy("strand", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("a")).agg(F.max("ts").alias("b"))
    joined = I.join_points(df, castings, "ts", "a", "b", ["strand"])
    assert largest_task_share(joined) < 0.2


def test_a_scan_shuffles_its_rows_once(spark, many_partitions):
    chunk = bucket("ts", 3_600)
    one = O.scan(skewed(spark), ["strand"], ["ts", "id"], chunk, position="pos")
    text = plan(one)
    # The rows, the summary rows, and the carries twice: ordered per series, and
    # brought to the rows, which stay where they are.
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 4
    two = O.scan(one, ["strand"], ["ts", "id"], counts={"n": F.col("v") > 0.5})
    assert largest_task_share(two) < 0.2


def test_hot_group_quantile_never_sorts_the_group(spark):
    df = skewed(spark).withColumn("x", F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("v") * 100))
    out = {r.strand: r.m for r in quantiles(df, ["strand"], "x", {"m": 0.5}).collect()}
    want = {r.strand: r.m for r in df.groupBy("strand").agg(F.percentile("x", 0.5).alias("m")).collect()}
    assert out == pytest.approx(want)
    assert "percentile" not in plan(quantiles(df, ["strand"], "x", {"m": 0.5}))


def test_windows_hold_their_invariants(spark):
    df = skewed(spark, 6_000)
    starts = W.segmented_starts(df, ["strand"], ["ts", "id"], bucket("ts", 3_600), "v", 5, 0.7, [], None, 600, block_rows=50)
    picks = W.pick_windows(starts, ["strand"], 5, piece_rows=64)
    rows = W.window_rows(starts.select("strand", "pos", "segment_id", "steady"), picks.drop("segment_id"), ["strand"], 5)
    per_window = rows.groupBy("strand", "start_pos").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("segment_id").alias("segments"),
        F.max(F.when(F.col("pos") == F.col("start_pos"), F.col("steady"))).alias("steady"),
    )
    assert per_window.filter((F.col("n") != 5) | (F.col("segments") != 1) | ~F.col("steady")).count() == 0
    assert rows.groupBy("strand", "pos").count().filter("count > 1").count() == 0
    covered = rows.select("strand", "pos")
    missed = starts.filter("steady").select("strand", "pos")
    # A steady start is either inside a chosen window or is one.
    assert missed.join(covered, ["strand", "pos"], "left_anti").count() == 0
