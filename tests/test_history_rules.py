"""Splits, namespaces and supervision: small rules with known answers."""

from pyspark.sql import functions as F

from winnow.operators import catalog as K
from winnow.operators import history as H


def test_supervision_cuts_the_prompt_never_the_response(spark):
    df = spark.createDataFrame([([1, 2, 3], [7, 8]), ([1], [7, 8, 9, 10, 11])], "p array<int>, r array<int>")
    ids, labels = H.assemble_supervision(F.col("p"), F.col("r"), 4)
    got = df.select(ids.alias("i"), labels.alias("l")).collect()
    assert (got[0]["i"], got[0]["l"]) == ([2, 3, 7, 8], [-100, -100, 7, 8])
    assert (got[1]["i"], got[1]["l"]) == ([7, 8, 9, 10, 11], [7, 8, 9, 10, 11])


def test_leave_last_needs_five_events(spark):
    rows = [("a", i, f"a{i}") for i in range(6)] + [("b", i, f"b{i}") for i in range(4)]
    got = H.leave_last_split(spark.createDataFrame(rows, "u string, t int, e string"), "u", ["t", "e"]).collect()
    split = {r["e"]: r["split"] for r in got}
    assert set(split) == {"a3", "a4", "a5"} and split["a3"] == "train" and split["a5"] == "test"
    assert split["a4"] in {"selection", "calibration"}


def test_namespace_numbers_shared_prefixes(spark):
    df = spark.createDataFrame([("y", 1, 2, 3), ("x", 1, 2, 3), ("z", 1, 2, 4)], "item_id string, c1 int, c2 int, c3 int")
    got = {r["item_id"]: r for r in K.namespace_catalog(df, 1).collect()}
    assert got["x"]["sid"] == "<|sid_begin|><s_a_257><s_b_258><s_c_259><s_d_256><|sid_end|>"
    assert got["y"]["suffix"] == 1 and got["y"]["collision"] and not got["z"]["collision"]


def test_disjoint_parts(spark):
    rows = [(f"u{i % 20}", f"q{i}") for i in range(60)]
    got = H.one_query_per_user(spark.createDataFrame(rows, "u string, q string"), "u", "q", {"tune": 5, "audit": 7}, 3).collect()
    assert len(got) == len({r["u"] for r in got}) == 12
    assert sum(r["part"] == "tune" for r in got) == 5


def test_population_audit_by_hand(spark):
    data = [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    row = H.population_audit(spark.createDataFrame(data, "user_id string, history_len int")).first()
    assert (row["users"], row["positions"], row["max_per_user"]) == (2, 4, 3)
    assert row["top10_share"] == 0.75 and row["share_len_1"] == 0.5 and row["mean_history"] == 1.75
