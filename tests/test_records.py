"""Record contracts, sampling, metrics, graphs, estimators and exploration: rules and known answers."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.functions.keys import json_list
from winnow.operators import catalog as K
from winnow.operators import contracts as C
from winnow.operators import estimators as E
from winnow.operators import graph as G
from winnow.operators import history as H
from winnow.operators import ranking as M
from winnow.operators import sampling as S
from winnow.plans.bootstrap import poisson_weights
from winnow.schemas import SFT
from winnow.sources import readers as R


def sft(spark, *changes):
    base = dict(record_id="r", root_id="o", task="t", domain="d", source="s", split="train", input_ids=[1, 3, 4], labels=[-100, 3, 4],
                recipe_id="x", user_id=None, label_origin="observed")
    return spark.createDataFrame([tuple({**base, **c}.values()) for c in changes], SFT)


def test_each_rule_fires_alone(spark):
    cases = {
        "empty_string": {"task": " "}, "split": {"split": "dev"}, "user_id": {"user_id": ""}, "length": {"labels": [-100, 3]},
        "token": {"input_ids": [1, -3, 4], "labels": [-100, -100, 4]}, "label": {"labels": [-100, 9, 4]},
        "first_label": {"labels": [1, 3, 4]}, "cost": {"labels": [-100, -100, -100]},
    }
    df = sft(spark, {}, *[{"record_id": k, **v} for k, v in cases.items()])
    found = {}
    for r in C.sft_violations(df).collect():
        found.setdefault(r["record_id"], set()).add(r["rule"])
    assert "r" not in found
    assert all(k in found[k] for k in cases)


def test_cost_skips_the_first_label(spark):
    assert C.record_keys(sft(spark, {"labels": [1, 3, -100]})).first()["cost"] == 1


def test_leaks_allow_train_users_only(spark):
    rows = C.record_keys(sft(
        spark, {"record_id": "a", "root_id": "1", "user_id": "u"}, {"record_id": "b", "root_id": "2", "split": "test", "user_id": "u", "input_ids": [9, 3, 4]},
    ))
    assert C.partition_leaks(rows).count() == 0
    more = C.record_keys(sft(
        spark, {"record_id": "b", "root_id": "2", "split": "test", "user_id": "u", "input_ids": [9, 3, 4]},
        {"record_id": "c", "root_id": "3", "split": "tune", "user_id": "u", "input_ids": [8, 3, 4]}, {"record_id": "d", "root_id": "2", "split": "tune", "input_ids": [8, 3, 4]},
    ))
    assert {(r["kind"], r["splits"]) for r in C.partition_leaks(more).collect()} == {("user", "test,tune"), ("root", "test,tune")}


def test_fingerprint_ignores_order(spark):
    a = C.record_keys(sft(spark, {"record_id": "a"}, {"record_id": "b"}, {"record_id": "c"}))
    C.require_same_pool(a, a.orderBy(F.desc("record_id")).repartition(3))
    with pytest.raises(ValueError):
        C.require_same_pool(a, a.filter("record_id <> 'a'"))


def test_readers_fail_closed(spark, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    R.write_records(sft(spark, {}), good)
    assert R.read_sft(spark, good, "train").count() == 1
    with pytest.raises(ValueError, match="expected"):
        R.read_sft(spark, good, "test")
    with pytest.raises(Exception):
        R.write_records(sft(spark, {}), good)
    (tmp_path / "bad").write_text('{"record_id": "a"\n')
    with pytest.raises(ValueError, match="malformed"):
        R.read_sft(spark, bad)
    (tmp_path / "rev").write_text('{"user_id": "u", "parent_asin": "i", "timestamp": 5, "rating": 1.0}\n\n')
    row = R.read_reviews(spark, str(tmp_path / "rev"), "books").first()
    assert (row["timestamp"], row["domain"]) == (5, "books")
    (tmp_path / "rev2").write_text('{"user_id": "u", "parent_asin": "i"}\n')
    with pytest.raises(ValueError, match="timestamp"):
        R.read_reviews(spark, str(tmp_path / "rev2"), "books")


def test_encoder_output_is_checked(spark):
    def encode(frames):
        for f in frames:
            yield f.assign(record_id="same")

    with pytest.raises(ValueError):
        R.encode_records(sft(spark, {"record_id": "a"}, {"record_id": "b"}), encode)


def test_repair_uses_free_codes(spark):
    items = spark.createDataFrame([("a", 1, 1, 1, 0), ("b", 1, 1, 1, 0), ("c", 1, 1, 1, 1), ("d", 1, 1, 1, 0)], "item_id string, c1 int, c2 int, c3 int, c4 int")
    assert {r["item_id"]: r["new_code"] for r in K.repair_collisions(items).collect()} == {"b": 2, "d": 3}


def test_trie_paths_return_the_distribution(spark):
    items = spark.createDataFrame([("a", [1], 0.2), ("b", [1, 2], 0.3), ("c", [3], 0.5)], "item_id string, codes array<int>, q double")
    got = {r["item_id"]: r["path_probability"] for r in K.item_path_probability(items).collect()}
    assert got == {"a": pytest.approx(0.2), "b": pytest.approx(0.3), "c": pytest.approx(0.5)}


def test_history_category_ties_by_name(spark):
    events = spark.createDataFrame([("e1", "u", "p", "d", 1), ("e2", "u", "q", "d", 2), ("e3", "u", "r", "d", 3), ("e4", "u", "x", "d", 9)],
                                   "event_id string, user_id string, item_id string, domain string, timestamp bigint")
    cat = spark.createDataFrame([("d", "p", "P", "zoo", "t"), ("d", "q", None, "art", "t"), ("d", "r", None, None, "t")],
                                "domain string, item_id string, answer string, category string, title string")
    rows = H.task_rows(events, cat)
    got = H.history_category_task(rows, 10, 20).filter("root_id = 'e4'").first()
    assert got["output_text"] == "art" and got["input_text"].startswith('History: ["P", "q", "r"]\n')


def test_reservoir_is_nested_and_whole(spark):
    df = spark.createDataFrame([(f"r{i % 40}", i) for i in range(120)], "root string, i int")
    picked = {k: {r["i"] for r in S.root_reservoir(df.repartition(3), "root", k).collect()} for k in (5, 12, 100)}
    assert len(picked[5]) == 15 and picked[5] < picked[12] and len(picked[100]) == 120


def test_digest_cutoff_by_counting(spark, monkeypatch):
    monkeypatch.setattr(S, "SMALL", 3)
    df = spark.range(60).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    ordered = sorted(r["h"] for r in df.collect())
    assert [S.digest_cutoff(df, k) for k in (1, 20, 60)] == [ordered[0], ordered[19], ordered[59]]
    assert S.digest_cutoff(df, 61) is None


def test_weighted_draws_follow_the_law(hot):
    p = [1 / 3, 0.3, 0.2, 0.1, 0.05, 1 - 1 / 3 - 0.65]
    df = hot.createDataFrame(list(enumerate(p)), "k int, p double")
    draws = S.weighted_draws(df, "k", "p", 4000, 1)
    seen = {r["k"]: r["n"] / 4000 for r in draws.groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert draws.count() == 4000 and all(abs(seen[i] - x) < 0.03 for i, x in enumerate(p))


def test_speculative_pick_follows_the_target(spark):
    target, draft, n = [0.2, 0.3, 0.5], [0.6, 0.3, 0.1], 3000
    df = spark.range(n).select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t"), F.lit(d).alias("d")) for i, (t, d) in enumerate(zip(target, draft))])).alias("s")).select("id", "s.*")
    got = S.speculative_pick(df, ["id"], "i", "t", "d", 4).collect()
    assert sum(r["accepted"] for r in got) / n == pytest.approx(0.6, abs=0.04)
    for i, t in enumerate(target):
        assert sum(r["pick"] == i for r in got) / n == pytest.approx(t, abs=0.04)
    picks = S.categorical_pick(df, ["id"], "i", "t", 9).collect()
    assert sum(r["pick"] == 2 for r in picks) / n == pytest.approx(0.5, abs=0.04)
    a = df.select("id", "i", F.col("t").alias("p")).filter("id = 0")
    b = df.select("id", "i", F.col("d").alias("p")).filter("id = 0")
    law = {r["i"]: r for r in G.speculative_identity(a, b, ["id"], "i").collect()}
    assert law[0]["acceptance"] == pytest.approx(0.6) and [law[i]["output"] for i in range(3)] == pytest.approx(target)


def test_bad_items_keep_their_slots(spark):
    q = spark.createDataFrame([("q1", "d", "t", ["b"], ["illegal", "b"]), ("q2", "d", "t", ["a", "b"], ["a", "a"]), ("q3", "d", "t", ["a"], [])],
                              "query_id string, domain string, task string, targets array<string>, predictions array<string>")
    cat = spark.createDataFrame([("d", "a"), ("d", "b")], "domain string, item_id string")
    got = {r["query_id"]: r for r in M.ranking_per_query(q, cat, 2).collect()}
    assert got["q1"]["recall"] == 1 and got["q1"]["ndcg"] == pytest.approx(1 / math.log2(3))
    assert got["q2"]["recall"] == 0.5 and got["q2"]["invalid_slots"] == 1
    assert got["q3"]["recall"] == 0 and got["q3"]["returned_slots"] == 0


def test_paired_bootstrap_needs_the_same_records(spark):
    left = spark.createDataFrame([(i, 1 + i % 4) for i in range(60)], "record_id int, rank int")
    row = M.paired_bootstrap(left, left, 200).first()
    assert row["difference"] == row["low"] == row["high"] == 0
    with pytest.raises(ValueError, match="differ"):
        M.paired_bootstrap(left, left.filter("record_id > 3"), 50)


def test_poisson_weights_have_mean_and_variance_one():
    w = poisson_weights(np.arange(2000, dtype=np.int64) * 7919, 300, 5)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert (w == poisson_weights(np.arange(2000, dtype=np.int64) * 7919, 300, 5)).all()


def test_best_run_takes_the_first_within_tolerance(spark):
    df = spark.createDataFrame([("m", 0, 0.5), ("m", 1, 0.7), ("m", 2, 0.7)], "m string, step int, s double")
    assert M.best_run(df, "m", "step", ["s"], "step").first()["best_by_s"] == 1


def test_random_walk_matches_a_dense_solve(spark):
    rng = np.random.default_rng(0)
    n = 7
    w = rng.integers(0, 4, size=(n, n)).astype(float)
    w[3] = 0  # a dangling node
    p = rng.random(n)
    p /= p.sum()
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "src int, dst int, w double")
    nodes = spark.createDataFrame(list(enumerate(map(float, p))), "node int, p double")
    got = np.asarray([r["rank"] for r in G.personalized_pagerank(edges, nodes, 0.6, 1e-9).orderBy("node").collect()])
    step = np.where(w.sum(1, keepdims=True) > 0, w / np.maximum(w.sum(1, keepdims=True), 1), p[None])
    r = p.copy()
    for _ in range(200):
        r = 0.6 * step.T @ r + 0.4 * p
    assert got == pytest.approx(r, abs=1e-8)


def test_absorbing_value(spark):
    q = spark.createDataFrame([(0, 0, 0.4), (0, 1, 0.3), (1, 0, 0.1), (1, 1, 0.5)], "src int, dst int, p double")
    r = spark.createDataFrame([(0, 1.0), (1, 1.0)], "state int, r double")
    got = [x["value"] for x in G.absorbing_value(q, r).orderBy("state").collect()]
    assert got == pytest.approx([2.96296, 2.59259], abs=1e-4)
    loop = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src int, dst int, p double")
    with pytest.raises(ValueError, match="not absorbing"):
        G.absorbing_value(loop, r, max_iter=10)


def test_safe_mixture(spark):
    df = spark.createDataFrame([("g", 0, 1.0, 0.0, 0.9), ("g", 1, 0.0, 1.0, 0.3)], "g string, i int, b double, e double, l double")
    row = G.safe_mixture(df, ["g"], "b", "e", "l", 0.6).orderBy("i").first()
    assert row["epsilon"] == pytest.approx(0.5) and row["q"] == pytest.approx(0.5)


def test_missing_outcomes_are_not_zeros(spark):
    df = spark.createDataFrame([(0.8, True), (None, False), (None, False), (None, False)], "y double, o boolean")
    df = df.withColumn("e", F.lit(0.25)).withColumn("mu", F.lit(0.1))
    assert E.mar_dr_mean(df, "y", "o", "e", "mu").first()["estimate"] == pytest.approx(0.8)


def test_support_violation_is_infinite(spark):
    df = spark.createDataFrame([(0.5, 0.0, [1.0, 0.0]), (0.5, 1.0, [1.0, 1.0])], "p double, q double, A array<double>")
    assert all(r["variance"] == math.inf for r in E.variance_objectives(df, "p", "q", "A", 2).collect())


def test_group_advantages_by_hand(spark):
    df = spark.createDataFrame([("p", 1.0), ("p", 2.0), ("p", 6.0)], "p string, r double")
    loo = sorted(r["adv_r"] for r in E.group_advantages(df, "p", ["r"]).collect())
    assert loo == pytest.approx([1 - 4, 2 - 3.5, 6 - 1.5])
    flat = spark.createDataFrame([("p", 1.0), ("p", 1.0)], "p string, r double")
    assert all(r["adv_r"] == 0 for r in E.group_advantages(flat, "p", ["r"], "grpo").collect())


def test_list_literals_are_parsed_or_refused(spark):
    lists = [["a", "b"], ["it's", 'say "x"'], ["both ' and \"", "back\\slash", "\\n literal", "new\nline"], [], ["x, 'y'"]]
    df = spark.createDataFrame([(i, repr(x)) for i, x in enumerate(lists)], "i int, h string")
    assert {r["i"]: list(r["o"]) for r in df.select("i", R.list_literal("h").alias("o")).collect()} == dict(enumerate(lists))
    for bad in ("['a'", "a", "[1,2]", None, "['a' 'b']"):
        with pytest.raises(Exception, match="not a list of strings"):
            spark.createDataFrame([(bad,)], "h string").select(R.list_literal("h")).collect()


def test_prompts_hold_valid_json(spark):
    items = ['say "hi"', "back\\slash", "tab\t", "plain"]
    got = spark.createDataFrame([(items,)], "a array<string>").select(json_list(F.col("a")).alias("j")).first()["j"]
    assert json.loads(got) == items and got.count('", "') == 3
    lists = [[], ["a"], ["a", "b, c"], ['x",', "y"], ["", ""], ["é", "\u0001"], ["end\\", "next"], ["it's", "new\nline"]]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, a array<string>").select("i", json_list(F.col("a")).alias("j")).collect()
    assert {r["i"]: json.loads(r["j"]) for r in rows} == dict(enumerate(lists))
    assert {r["i"]: r["j"] for r in rows} == {i: json.dumps(x, ensure_ascii=False) for i, x in enumerate(lists)}
    none = spark.createDataFrame([(None,), (["a", None],)], "a array<string>").select(json_list(F.col("a")).alias("j")).collect()
    assert [r["j"] for r in none] == [None, '["a", null]']


def test_draws_cover_every_interval_and_do_not_depend_on_partitions(spark):
    rows = [(i, 0.1 * (i % 7)) for i in range(200)] + [(1000, 500.0)]
    a = spark.createDataFrame(rows, "k bigint, p double")
    drawn = [sorted(map(tuple, S.weighted_draws(a.repartition(n), "k", "p", 20_000, 3).collect())) for n in (1, 7)]
    assert drawn[0] == drawn[1] and [d for d, _ in drawn[0]] == list(range(20_000))
    heavy = sum(k == 1000 for _, k in drawn[0]) / 20_000
    assert abs(heavy - 500 / (500 + sum(p for _, p in rows[:-1]))) < 0.01
    with pytest.raises(ValueError):
        S.weighted_draws(a.filter("p = 0"), "k", "p", 5, 3)
