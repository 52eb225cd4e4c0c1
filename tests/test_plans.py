"""Plan shapes that the scale design relies on."""

import re

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_scan_pruned_and_partial_aggregate(spark):
    p = plan(E.queries()["category_counts"](spark, SF))
    assert "partial_count" in p
    assert re.search(r"ReadSchema: struct<user_id:bigint>", p) or "user_id" in p.split("FileScan")[1].split("]")[0]
    assert "props" not in p.split("FileScan")[1].split("\n")[0]


def test_class_rank_split_by_hash_bucket(spark):
    p = plan(E.queries()["balance_classes"](spark, SF))
    windows = [ln for ln in p.splitlines() if "Window [" in ln and "row_number" in ln]
    assert windows and all("__hb" in ln for ln in windows)


def test_no_global_window_over_log_lines(spark):
    """A window without a partition key may only read an aggregate (the
    per-bucket totals), never the log lines themselves."""
    lines = plan(E.queries()["gpu_steps"](spark, SF)).splitlines()
    for i, ln in enumerate(lines):
        if "Window [" in ln and ln.rstrip().endswith("]") and re.search(r"\], \[[^\]]*ASC[^\]]*\]$", ln) \
                and not re.search(r"\], \[[^\]]+\], \[", ln):
            below = next(x for x in lines[i + 1:] if "HashAggregate" in x or "Scan" in x)
            assert "HashAggregate" in below, ln


def test_resample_grid_is_broadcast(spark):
    p = plan(E.queries()["gpu_resample"](spark, SF))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_dedup_is_an_aggregate_not_a_window(spark):
    p = plan(E.queries()["last_picture_per_id"](spark, SF))
    assert "max_by" in p and "row_number" not in p


def test_class_cut_comes_before_the_ranking_shuffle(spark):
    """The filter on hash sub-buckets lies below the window that ranks."""
    p = plan(E.queries()["balance_classes"](spark, SF))
    assert "__cut" in p and p.index("row_number") < p.index("__cut#")


def test_schedules_need_no_nested_loop(spark):
    from tessera.operators import train as T
    it = spark.range(5000).selectExpr("id as iteration")
    df = T.lookup_lr(it, T.schedule_frame(spark, [(10, 0.5), (2000, 0.25)]), base_lr=1.0)
    assert "NestedLoop" not in plan(df) and "NestedLoop" not in plan(E.queries()["lr_schedule"](spark, SF))
    got = {r["iteration"]: r["lr"] for r in df.collect()}
    assert len(got) == 5000 and [got[i] for i in (0, 9, 10, 1999, 2000, 4999)] == [1.0, 1.0, 0.5, 0.5, 0.25, 0.25]


def test_class_index_has_no_window(spark):
    for name in ("index_labels", "index_many_labels"):
        assert "Window" not in plan(E.queries()[name](spark, SF))


def test_many_logs_rank_blocks_not_lines(spark):
    """Row numbers over a log are taken of its blocks, cut before the shuffle."""
    p = E.queries()["gpu_steps_by_log"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p
