"""What the physical plans of the registered queries must and must not contain."""

import re

import pytest

from __spark_entry__ import entry
from musterroll.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
STREAMS = {n for n in QUERIES if n.endswith("_stream")} | {"s2_read_watch", "t4_coalesce_updates"}
PYTHON = {"t1_replay_autoscaler", "t3_throttle", "t9_scaling_plan"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_cross_joins_and_no_row_udfs(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    assert ("MapInArrow" in plan) == (name in PYTHON)


def shuffles(plan):
    return len(re.findall(r"Exchange (hash|range|round)", plan))


@pytest.mark.parametrize("name,most", [
    ("a1_count_members", 1), ("a2_component_board", 1), ("a5_job_runs", 1), ("a6_latest_state", 1),
    ("a7_replay_patches", 1), ("t7_preferred_source", 1), ("w2_field_changes", 1),
    ("w3_stuck_in_phase", 1), ("j11_ready_within", 1), ("t3_throttle", 1), ("x8_overlay_settings", 1),
])
def test_one_shuffle_is_enough(spark, name, most):
    assert shuffles(plan_of(QUERIES[name](spark, SF))) <= most


@pytest.mark.parametrize("name", [
    "f3_drop_reserved_keys", "f4_printer_columns", "f5_split_valid_names", "f7_check_constraints",
    "s7_write_specs", "x2_merge_layers", "x4_inject_env", "x10_flatten_manifest", "e1_expand_resources",
])
def test_row_by_row_rules_do_not_shuffle(spark, name):
    assert shuffles(plan_of(QUERIES[name](spark, SF))) == 0


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(QUERIES["j6_reconcile"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan
    plan = plan_of(QUERIES["s1_read_snapshot"](spark, SF))
    assert "PushedFilters: [In(c_nationkey, [1,5,9])]" in plan
    plan = plan_of(QUERIES["f1_select_labels"](spark, SF))
    assert "EqualTo(c_mktsegment,BUILDING)" in plan


def test_replay_sits_on_a_clustered_window(spark):
    plan = plan_of(QUERIES["t1_replay_autoscaler"](spark, SF))
    below = plan[plan.index("MapInArrow"):]
    assert "Window" in below[: below.index("Join")]


def test_entry(spark):
    result = entry(spark)
    assert result.columns == ["group_id", "desired", "current", "needed", "action"]
    assert result.count() == 1500


def test_skewed_owner_join_is_split(spark):
    """An equi join without hints leaves a hot owner's children to adaptive splitting."""
    from pyspark.sql import functions as F

    from musterroll.operators.relate import orphans, owner_of

    children = spark.range(0, 60000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("owner"), "id"
    )
    parents = spark.range(0, 400).select(F.col("id").alias("owner"), F.lit("p").alias("name"))
    eager = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1kb",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4kb",
    }
    before = {k: spark.conf.get(k, None) for k in eager}
    try:
        for name, value in eager.items():
            spark.conf.set(name, value)
        for joined, kept in [
            (owner_of(children, parents, ["owner"]), 20000 + 32000),
            (orphans(children, parents, ["owner"]), 8000),
        ]:
            assert len(joined.collect()) == kept
            assert "skew=true" in plan_of(joined)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
