"""The sliced plans must equal plain windows, whatever share of the rows one key holds."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from winnow.operators.history import strict_history, with_history
from winnow.plans.ordered import hot_keys, top_per_group, with_group, with_previous, with_row_number, with_running_sum
from winnow.sources.readers import feedback_log_to_records
from workload import all_queries
from workload import tables as T


def rows(spark, n=120, seed=0):
    rng = random.Random(seed)
    data = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(6)}", rng.randrange(1000), i, rng.randrange(9)) for i in range(n)]
    return spark.createDataFrame(data, "k string, o int, id int, v int")


def same(left, right):
    assert sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


@pytest.mark.parametrize("seed", [0, 1])
def test_row_number_and_running_sum_match_windows(hot, seed):
    df = rows(hot, seed=seed)
    order = [F.col("o"), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order)
    same(with_row_number(df, ["k"], order), df.withColumn("rn", F.row_number().over(w).cast("bigint")))
    summed = df.withColumn("running", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    same(with_running_sum(df, ["k"], order, "v"), summed)


def test_one_order_over_the_whole_table(hot):
    df = rows(hot)
    w = Window.orderBy("o", "id")
    same(with_row_number(df, [], [F.col("o"), F.col("id")]), df.withColumn("rn", F.row_number().over(w).cast("bigint")))


@pytest.mark.parametrize("h", [1, 3, 12])
def test_previous_values_cross_slices(hot, h):
    df = rows(hot)
    order = [F.col("o").desc(), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(-h, -1)
    same(with_previous(df, ["k"], order, "v", h), df.withColumn("previous", F.collect_list("v").over(w)))


def brute_history(events, h):
    out = {}
    for e in events:
        past = sorted((t, i, item) for u, t, i, item in events if u == e[0] and t < e[1])
        out[e[2]] = [x[2] for x in past][-h:]
    return out


@pytest.mark.parametrize("hot_mode", [False, True])
def test_strict_history_matches_the_definition(spark, hot_mode, request):
    if hot_mode:
        request.getfixturevalue("hot")
    rng = random.Random(3)
    events = [("hot" if rng.random() < 0.5 else f"u{rng.randrange(4)}", rng.randrange(25), f"{i:03d}", f"i{rng.randrange(30)}") for i in range(160)]
    df = spark.createDataFrame(events, "user_id string, t int, event_id string, item string")
    got = strict_history(df, ["user_id"], "t", F.col("item"), 4, ["event_id"])
    expected = brute_history(events, 4)
    for r in got.collect():
        assert (r["history"] or []) == expected[r["event_id"]]


def test_tied_events_share_the_earlier_history(spark):
    log = [("u", "old", "1", "a", "1", "0")] + [("u", f"v{i}", "5", "a", "1", "") for i in range(12)]
    df = spark.createDataFrame(log, "user_id string, video_id string, time_ms string, tab string, is_click string, is_like string")
    got = feedback_log_to_records(df, 10, 20, h=2).filter("timestamp = 5").collect()
    assert len(got) == 12 and all(r["history"] == ["old"] for r in got)


def test_unlabelled_rows_stay_in_history(spark):
    log = [("u", "a", "1", "t", "-1", "nan"), ("u", "b", "2", "t", "1", "None")]
    df = spark.createDataFrame(log, "user_id string, video_id string, time_ms string, tab string, is_click string, is_like string")
    got = feedback_log_to_records(df, 10, 20).collect()
    assert [(r["item_id"], r["history"], r["labels"]) for r in got] == [("b", ["a"], [1.0, None])]


def test_top_per_group_pushes_the_limit_below_the_shuffle(spark):
    plan = top_per_group(rows(spark), ["k"], [F.col("o"), F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_group_totals_do_not_gather_the_group(spark):
    plan = with_group(rows(spark), ["k"], F.sum("v").alias("s"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("hot_mode", [False, True])
def test_history_of_rows_without_key_time_or_item(spark, hot_mode, request):
    if hot_mode:
        request.getfixturevalue("hot")
    log = [("u", None, "a", "x"), ("u", 1, "b", None), ("u", 1, "c", "y"), ("u", 2, "d", "z"), ("u", 3, "e", "x"), ("u", 3, "f", "w"), ("u", 4, "g", "v"), (None, 1, "h", "x"), (None, 2, "i", "y")]
    df = spark.createDataFrame(log, "user_id string, t int, event_id string, item string")
    got = {r["event_id"]: r["history"] for r in strict_history(df, ["user_id"], "t", F.col("item"), 3, ["event_id"]).collect()}
    assert got == {"a": None, "b": ["x"], "c": ["x"], "d": ["x", None, "y"], "e": [None, "y", "z"], "f": [None, "y", "z"], "g": ["z", "x", "w"], "h": None, "i": None}


def test_strict_history_shuffles_events_once_and_joins_nothing(spark):
    events = spark.createDataFrame([("d", f"u{i % 5}", f"i{i % 9}", i // 3, f"{i:03d}") for i in range(60)], "domain string, user_id string, item_id string, timestamp int, event_id string")
    plan = with_history(events, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_purchases_meet_orders_in_one_shuffle_of_the_lines(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = T._buy(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and plan.count("Exchange hashpartitioning") == 2


def test_lengths_travel_to_popularity_not_histories(spark):
    plan = all_queries()["hist_nuisance_features"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.splitlines() if "Project" in line and "length#" in line]
    assert joined and not any("history#" in line and "size(" not in line for line in joined)
    assert "size(history" not in plan.split("Join", 1)[0]


def test_hot_keys_are_found_by_bucket(hot):
    df = rows(hot)
    most = {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
    assert {r["k"]: r["_n"] for r in hot_keys(df, ["k"]).collect()} == {k: n for k, n in most.items() if n > 5}
    hot.conf.set("spark.winnow.hotRows", "1000")
    assert hot_keys(df, ["k"]) is None
