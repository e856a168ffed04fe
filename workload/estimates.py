"""Observational estimators, allocations, group rewards, acquisition and eligibility."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from winnow.operators import acquire as A
from winnow.operators import estimators as E
from workload import tables as T
from workload.registry import query, r


def _observed(spark, sf):
    rows = T.feedback(spark, sf)
    share = rows.groupBy("scene").agg(F.avg(F.when(F.col("quality").isNotNull(), 1.0).otherwise(0.0)).alias("e"))
    return rows.join(share, "scene").select(
        "id", "scene", F.col("quality").alias("y"), F.col("quality").isNotNull().alias("observed"), "e", F.lit(0.5).alias("mu")
    )


@query(
    "obs_mar_dr_mean",
    """with e as (select scene, avg(case when quality is not null then 1.0 else 0.0 end) as e from feedback group by scene)
       select round(avg(0.5 + case when quality is not null then (quality - 0.5) / e else 0 end), 6) as estimate, count(*) as n
       from feedback join e using (scene)""",
    "feedback",
)
def obs_mar_dr_mean(spark, sf):
    return E.mar_dr_mean(_observed(spark, sf), "y", "observed", "e", "mu").select(r("estimate").alias("estimate"), "n")


@query(
    "obs_propensity_violations",
    """select cast(event_id as varchar) as event_id, 'propensity' as rule from events where value / 500.0 <= 0 or value / 50.0 > 1""",
)
def obs_propensity_violations(spark, sf):
    rows = T.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_id"), (F.col("value") / 50).alias("e"))
    return E.propensity_violations(rows, "event_id", "e")


def _policy(spark, sf):
    """The logged bandit with a fixed target policy and per-action mean rewards."""
    log = T.bandit(spark, sf)
    means = [x["m"] for x in log.groupBy("action").agg(F.avg("reward").alias("m")).orderBy("action").collect()]  # one per action
    k = len(means)
    pi = F.array(*[F.lit(2.0 * (i + 1) / (k * (k + 1))) for i in range(k)])
    mu = F.array(*[F.lit(float(x)) for x in means])
    return log.withColumn("pi", pi).withColumn("mu", mu).withColumn("a", F.col("action") - 1)


@query(
    "obs_dr_policy_value",
    """with k as (select max(action) as k from bandit), m as (select action, avg(reward) as mu, any_value(2.0 * action / (k * (k + 1))) as pi
                                                              from bandit, k group by action),
       base as (select sum(pi * mu) as b from m)
       select round(avg(b + pi / e * (reward - mu)), 6) as estimate,
         round(pow(sum(pi / e), 2) / sum(pow(pi / e, 2)), 3) as ess
       from bandit join m using (action), base""",
    "bandit",
)
def obs_dr_policy_value(spark, sf):
    out = E.dr_policy_value(_policy(spark, sf), "reward", "a", "e", "pi", "mu")
    return out.select(r("estimate").alias("estimate"), r("ess", 3).alias("ess"))


@query(
    "obs_mature",
    """select event_id from ev where "timestamp" + 604800 <= 1706659200""",
    "ev",
)
def obs_mature(spark, sf):
    return E.mature(T.ev(spark, sf), "timestamp", 604800, 1706659200).select("event_id")


@query(
    "obs_masked_labels",
    """select id, coalesce(quality, 0.0) as quality, coalesce(toxic, 0.0) as toxic, quality is not null as known from feedback""",
    "feedback",
)
def obs_masked_labels(spark, sf):
    rows = T.feedback(spark, sf)
    y, mask = E.masked_labels(F.array("quality", "toxic"), F.array(F.col("quality").isNotNull(), F.col("toxic").isNotNull()))
    return rows.select("id", y.alias("y"), mask.alias("m")).select(
        "id", F.col("y")[0].alias("quality"), F.col("y")[1].alias("toxic"), F.col("m")[0].alias("known")
    )


@query(
    "obs_noise_corrected_loss",
    """with z as (select id, (n_chars - 1000) / 1000.0 as z, quality as y from feedback where quality is not null),
       l as (select id, greatest(z, 0.0) + ln(1 + exp(-abs(z))) - y * z as t, greatest(z, 0.0) + ln(1 + exp(-abs(z))) - (1 - y) * z as f from z)
       select id, round((0.8 * t - 0.2 * f) / 0.6, 6) as loss from l""",
    "feedback",
)
def obs_noise_corrected_loss(spark, sf):
    rows = T.feedback(spark, sf).filter("quality is not null")
    z = (F.col("n_chars") - 1000) / 1000.0
    return rows.select("id", r(E.noise_corrected_loss(z, F.col("quality"), 0.2)).alias("loss"))


def _parts(spark, sf):
    """Parts with a uniform base and two second moments."""
    rows = T.table(spark, sf, "part")
    n = rows.agg(F.count("*").alias("n")).select("n").scalar()
    return rows.select(
        F.col("p_partkey").alias("id"), (F.lit(1.0) / n).alias("p"), F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").alias("price"), "p_brand",
    )


@query(
    "obs_scalar_allocation",
    """select p_partkey as id, round(sqrt(p_size) / sum(sqrt(p_size)) over (), 9) as q from part""",
)
def obs_scalar_allocation(spark, sf):
    return E.scalar_allocation(_parts(spark, sf), "p", "size").select("id", r("q", 9).alias("q"))


@query(
    "obs_variance_objectives",
    """with t as (select count(*) as n, sum(p_size) as s from part)
       select 0 as objective, round(sum(p_size / (n * n) / (p_size / s)), 6) as variance from part, t
       union all select 1, round(sum(p_retailprice / (n * n) / (p_size / s)), 6) from part, t""",
)
def obs_variance_objectives(spark, sf):
    rows = _parts(spark, sf)
    total = rows.agg(F.sum("size").alias("s")).select("s").scalar()
    rows = rows.withColumn("q", F.col("size") / total).withColumn("A", F.array("size", "price"))
    out = E.variance_objectives(rows, "p", "q", "A", 2)
    return out.select("objective", r("variance").alias("variance"))


@query("obs_minimax_allocation")
def obs_minimax_allocation(spark, sf):
    """Two conflicting second moments over all parts."""
    rows = _parts(spark, sf).withColumn("A", F.array(F.col("size") / 25.0, F.lit(1000.0) / F.col("price")))
    q, info = E.minimax_allocation(rows, "id", "p", "A", 2, 0.05)
    return q.withColumn("gap", F.lit(info["gap"])).withColumn("upper", F.lit(info["upper"]))


@query(
    "obs_corrected_estimate",
    """with c as (select l_partkey, count(*) as k from lineitem group by 1), n as (select count(*) as lines from lineitem),
       m as (select count(*) as parts from part)
       select round(avg(p_retailprice * (1.0 / parts) / (k * 1.0 / lines)), 4) as price
       from lineitem join part on l_partkey = p_partkey join c using (l_partkey), n, m""",
)
def obs_corrected_estimate(spark, sf):
    """Every line is a draw of its part; the correction restores the mean over parts."""
    lines = T.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))
    n = lines.agg(F.count("*").alias("n")).select("n").scalar()
    share = lines.groupBy("id").agg(F.count("*").alias("k")).withColumn("q", F.col("k") / n)
    values = _parts(spark, sf).join(share, "id")
    return E.corrected_estimate(lines, values, "id", ["price"], "p", "q").select(r("price", 4).alias("price"))


@query(
    "obs_cost_allocation",
    """with s as (select p_brand, count(*) * 1.0 / (select count(*) from part) as p, var_pop(p_retailprice) as v, avg(p_size) as c from part group by 1),
       z as (select *, p * sqrt(v / c) as z from s)
       select p_brand, round(10000 * z / (select sum(c * z) from z), 6) as n from z""",
)
def obs_cost_allocation(spark, sf):
    rows = _parts(spark, sf)
    strata = rows.groupBy("p_brand").agg(F.sum("p").alias("p"), F.var_pop("price").alias("v"), F.avg("size").alias("c"))
    return E.cost_allocation(strata, "p", "v", "c", 10000).select("p_brand", r("n").alias("n"))


def _samples(spark, sf):
    """Lines as samples of their order's group; single-line orders are no groups."""
    lines = T.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), "l_tax"
    )
    return lines.join(E.small_groups(lines, "l_orderkey").select("l_orderkey"), "l_orderkey", "left_anti")


_GROUPS = """g as (select *, count(*) over w as n, avg(l_extendedprice) over w as mp, avg(l_discount) over w as md,
       stddev_pop(l_extendedprice) over w as sp, stddev_pop(l_discount) over w as sd from lineitem window w as (partition by l_orderkey)),
     adv as (select l_orderkey, l_linenumber, l_discount, l_tax, (l_extendedprice - mp) * n / (n - 1) as lp, (l_discount - md) * n / (n - 1) as ld,
       (l_extendedprice - mp) / greatest(sp, 1e-8) as gp, (l_discount - md) / greatest(sd, 1e-8) as gd from g where n > 1)"""


@query(
    "obs_group_advantages",
    f"with {_GROUPS} select l_orderkey, l_linenumber, l_tax, l_discount, round(lp, 6) as adv_price, round(ld, 8) as adv_discount from adv",
)
def obs_group_advantages(spark, sf):
    rows = E.group_advantages(_samples(spark, sf), "l_orderkey", ["price", "discount"], "loo")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_tax", F.col("discount").alias("l_discount"), r("adv_price", 6).alias("adv_price"), r("adv_discount", 8).alias("adv_discount")
    )


@query(
    "obs_group_advantages_standardised",
    f"with {_GROUPS} select l_orderkey, count(*) as n, round(min(gp), 4) as low, round(max(gp), 4) as high from adv group by l_orderkey",
)
def obs_group_advantages_standardised(spark, sf):
    rows = E.group_advantages(_samples(spark, sf), "l_orderkey", ["price"], "grpo")
    return rows.groupBy("l_orderkey").agg(
        F.count("*").alias("n"), r(F.min("adv_price"), 4).alias("low"), r(F.max("adv_price"), 4).alias("high")
    )


@query(
    "obs_policy_surrogate",
    f"""with {_GROUPS}, t as (select l_orderkey, l_linenumber, exp(l_discount - l_tax) as ratio, 0.6 * gp + 0.4 * gd as a from adv),
        p as (select l_orderkey, -avg(least(ratio * a, least(greatest(ratio, 0.95), 1.05) * a)) * max(l_linenumber / 4.0) as v from t group by 1)
        select round(avg(v), 6) as surrogate, count(*) as prompts from p""",
)
def obs_policy_surrogate(spark, sf):
    rows = E.group_advantages(_samples(spark, sf), "l_orderkey", ["price", "discount"], "grpo")
    rows = rows.withColumn("logp", -F.col("l_tax")).withColumn("old", -F.col("discount")).withColumn("ratio", F.col("l_linenumber") / 4.0)
    out = E.policy_surrogate(rows, "l_orderkey", "logp", "old", ["adv_price", "adv_discount"], [0.6, 0.4], "ratio", 0.05)
    return out.select(r("surrogate").alias("surrogate"), "prompts")


@query(
    "obs_categorical_kl",
    """with n as (select user_id, domain, count(*) as n from ev group by all), t as (select user_id, sum(n) as t from n group by 1),
       g as (select domain, sum(n) * 1.0 / (select sum(n) from n) as s from n group by 1)
       select user_id, round(sum((n * 1.0 / t) * (ln(n * 1.0 / t) - ln(s))), 6) as kl from n join t using (user_id) join g using (domain) group by user_id""",
    "ev",
)
def obs_categorical_kl(spark, sf):
    counts = T.ev(spark, sf).groupBy("user_id", "domain").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("s")).select("s").scalar()
    shares = counts.groupBy("domain").agg((F.log(F.sum("n") / total)).alias("ref"))
    users = counts.groupBy("user_id").agg(F.sum("n").alias("t"))
    rows = counts.join(users, "user_id").join(shares, "domain").withColumn("logp", F.log(F.col("n") / F.col("t")))
    return E.categorical_kl(rows, "user_id", "logp", "ref").select("user_id", r("kl").alias("kl"))


@query(
    "obs_feedback_metrics",
    """with z as (select quality, toxic, (n_chars - 1000) / 1000.0 as a, (200 - n_chars) / 1000.0 as b from feedback)
       select 0 as objective, round(avg(greatest(a, 0) + ln(1 + exp(-abs(a))) - quality * a), 6) as bce,
         round(avg(pow(1 / (1 + exp(-a)) - quality, 2)), 6) as brier, count(quality) as n from z where quality is not null
       union all select 1, round(avg(greatest(b, 0) + ln(1 + exp(-abs(b))) - toxic * b), 6),
         round(avg(pow(1 / (1 + exp(-b)) - toxic, 2)), 6), count(toxic) from z where toxic is not null""",
    "feedback",
)
def obs_feedback_metrics(spark, sf):
    c = F.col("n_chars")
    rows = T.feedback(spark, sf).select(
        F.array((c - 1000) / 1000.0, (F.lit(200) - c) / 1000.0).alias("logits"), F.array("quality", "toxic").alias("labels")
    )
    out = E.feedback_metrics(rows, "logits", "labels", 2)
    return out.select("objective", r("bce").alias("bce"), r("brier").alias("brier"), "n")


@query(
    "obs_reduce_token_loss",
    """with t as (select record_id, unnest(input_ids) as i, unnest(labels) as y from sft_all), u as (select record_id, (i % 97) / 10.0 as l from t where y <> -100),
       p as (select record_id, sum(l) as s, count(*) as c from u group by 1)
       select round(sum(s) / sum(c), 6) as token_mean, round(avg(s / c), 6) as example_mean, cast(sum(c) as bigint) as tokens, count(*) as records from p""",
    "sft_all",
)
def obs_reduce_token_loss(spark, sf):
    out = E.reduce_token_loss(_tokens(spark, sf), "record_id", "label", "loss")
    return out.select(r("token_mean").alias("token_mean"), r("example_mean").alias("example_mean"), "tokens", "records")


def _tokens(spark, sf):
    return T.sft_all(spark, sf).select("record_id", F.explode(F.arrays_zip("input_ids", "labels")).alias("t")).select(
        "record_id", F.col("t.labels").alias("label"), ((F.col("t.input_ids") % 97) / 10.0).alias("loss")
    )


@query(
    "obs_row_token_loss",
    """with t as (select record_id, unnest(input_ids) as i, unnest(labels) as y from sft_all)
       select record_id, round(avg((i % 97) / 10.0), 6) as loss, count(*) as tokens from t where y <> -100 group by record_id""",
    "sft_all",
)
def obs_row_token_loss(spark, sf):
    out = E.row_token_loss(_tokens(spark, sf), "record_id", "label", "loss")
    return out.withColumn("loss", r("loss"))


@query(
    "obs_reward_groups",
    """with last as (select domain, user_id, arg_max(item_id, {'t': "timestamp", 'e': event_id}) as answer from ev group by all)
       select domain || ':' || user_id as record, round(avg(case when item_id = answer then 1.0 else 0.0 end), 6) as reward_mean, count(*) as samples,
         min(case when item_id = answer then 1 else 0 end) < max(case when item_id = answer then 1 else 0 end) as mixed
       from ev join last using (domain, user_id) group by 1""",
    "ev",
)
def obs_reward_groups(spark, sf):
    ev = T.ev(spark, sf)
    last = ev.groupBy("domain", "user_id").agg(F.max_by("item_id", F.struct("timestamp", "event_id")).alias("answer"))
    rows = ev.join(last, ["domain", "user_id"]).withColumn("record", F.concat("domain", F.lit(":"), "user_id"))
    out = E.reward_groups(rows, "record", "answer", "item_id")
    return out.withColumn("reward_mean", r("reward_mean"))


# ---- acquisition ----------------------------------------------------------------------------------

_PAIRS = """pairs as (select event_id as pair_id, user_id as prompt_id, domain as chosen, 'click' as rejected,
     case when item_id = '0' then '' else item_id end as evidence_id, value / 200.0 as confidence,
     case when value < 50 then 'observed' when value < 100 then 'expert' when value < 150 then 'synthetic' else 'crowd' end as source,
     case when "timestamp" < 1705795200 then 'train' when "timestamp" < 1706227200 then 'validation' else 'late' end as split from ev)"""


def _pairs(spark, sf):
    v, t = F.col("value"), F.col("timestamp")
    return T.ev(spark, sf).select(
        F.col("event_id").alias("pair_id"), F.col("user_id").alias("prompt_id"), F.col("domain").alias("chosen"), F.lit("click").alias("rejected"),
        F.when(F.col("item_id") == "0", "").otherwise(F.col("item_id")).alias("evidence_id"), (v / 200.0).alias("confidence"),
        F.when(v < 50, "observed").when(v < 100, "expert").when(v < 150, "synthetic").otherwise("crowd").alias("source"),
        F.when(t < T.EVENT_TRAIN_END, "train").when(t < T.EVENT_SELECT_END, "validation").otherwise("late").alias("split"),
    )


@query(
    "acq_pair_violations",
    f"""with {_PAIRS} select pair_id, unnest(list_filter([case when chosen = rejected then 'trivial' end, case when evidence_id = '' then 'evidence_id' end,
          case when source = 'crowd' then 'source' end, case when confidence > 1 then 'confidence' end, case when split = 'late' then 'split' end],
          lambda x: x is not null)) as rule from pairs""",
    "ev",
)
def acq_pair_violations(spark, sf):
    return A.pair_violations(_pairs(spark, sf))


@query(
    "acq_accept_pairs",
    f"with {_PAIRS} select pair_id, source from pairs where split = 'train' and confidence >= 0.3 and source not in ('synthetic', 'simulator')",
    "ev",
)
def acq_accept_pairs(spark, sf):
    return A.accept_pairs(_pairs(spark, sf).filter("split = 'train'"), 0.3).select("pair_id", "source")


@query(
    "acq_rank_acquisition",
    """select id, round(((0.5 * (a0 - 0.1 * abs(a0)) + 0.3 * (a1 - 0.1 * abs(a1)) + 0.2 * (a2 - 0.1 * abs(a2))) - 0.001) / cost, 9) as score
       from wide join vec using (id)""",
    "wide vec",
)
def acq_rank_acquisition(spark, sf):
    rows = T.wide(spark, sf).withColumn("u", F.transform("a", lambda x: F.abs(x) * 0.1))
    return A.rank_acquisition(rows, "id", "a", "u", "cost", [0.5, 0.3, 0.2], 0.001).select("id", r("score", 9).alias("score"))


@query("acq_best_small_batch")
def acq_best_small_batch(spark, sf):
    """Which up to three label centroids would raise the margin of the pool of labels 5 to 9."""
    from winnow.functions.vectors import mean_by

    rows = T.wide(spark, sf)
    centers = mean_by(rows, ["label"], "a", out="a").select(
        F.col("label").cast("bigint").alias("id"), "a", (F.col("label") % 3 + 1).alias("cost")
    )
    out = A.best_small_batch(rows.filter("label >= 5"), centers, "id", "a", "cost", 5, 3)
    return spark.createDataFrame(
        [(",".join(out["selected"]), float(out["new_margin"]), float(out["gain"]), int(out["nodes"]))],
        "selected string, new_margin double, gain double, nodes bigint",
    )


def _candidates(spark, sf):
    return T.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("candidate_id"), F.col("p_name").alias("evidence_id"),
        F.col("p_size").cast("double").alias("required_memory_gb"), F.array("p_type", "p_brand").alias("required_equipment"),
        F.col("p_retailprice").alias("available_at"),
    )


_OWN = ["ECONOMY", "LARGE", "SMALL"] + [f"Brand#{i}" for i in range(1, 16)]
_OWN_SQL = "(" + ", ".join(f"'{x}'" for x in _OWN) + ")"
_ABLE = f"""able as (select cast(p_partkey as varchar) as candidate_id from part
       where p_size <= 30 and p_type in {_OWN_SQL} and p_brand in {_OWN_SQL} and p_retailprice <= 950)"""


@query("acq_eligible_candidates", f"with {_ABLE} select candidate_id from able")
def acq_eligible_candidates(spark, sf):
    return A.eligible_candidates(_candidates(spark, sf), 30.0, _OWN, 950.0).select("candidate_id")


@query(
    "acq_eligible_bundles",
    f"""with {_ABLE} select cast(l_orderkey as varchar) || '-' || l_linenumber as bundle_id, l_partkey, l_suppkey from lineitem
        where l_returnflag in ('A', 'R') and l_linestatus = 'O' and l_quantity <= 40
          and cast(l_partkey as varchar) in (select candidate_id from able) and cast(l_suppkey as varchar) in (select candidate_id from able)""",
)
def acq_eligible_bundles(spark, sf):
    lines = T.table(spark, sf, "lineitem")
    bundle = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    flag = F.col("l_returnflag")
    bundles = lines.select(
        bundle.alias("bundle_id"), F.col("l_partkey").cast("string").alias("method_id"), F.col("l_suppkey").cast("string").alias("dataset_id"),
        bundle.alias("compatibility_evidence_id"), F.when(flag == "A", "execution").when(flag == "R", "expert").otherwise("model").alias("verifier"),
        F.col("l_quantity").alias("verified_at"), (F.col("l_linestatus") == "O").alias("compatible"), "l_partkey", "l_suppkey",
    )
    out = A.eligible_bundles(bundles, _candidates(spark, sf), 30.0, _OWN, 950.0)
    return out.filter("verified_at <= 40").select("bundle_id", "l_partkey", "l_suppkey")


@query(
    "acq_coverage_value",
    """with c as (select p_brand, case when max(p_size / 500.0) >= 1 then 1.0 else 1 - exp(sum(ln(1 - p_size / 500.0))) end as v,
         max(length(p_type)) as w from part group by 1)
       select round(sum(v * w), 6) as value from c""",
)
def acq_coverage_value(spark, sf):
    rows = T.table(spark, sf, "part").select("p_brand", (F.col("p_size") / 500.0).alias("p"), F.length("p_type").alias("w"))
    return A.coverage_value(rows, "p_brand", "p", "w").select(r("value").alias("value"))


def _coverage_sql(k: int) -> str:
    """One step after another; `rest` holds what every direction has left."""
    gain = "list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i] * rest[i]))"
    steps = ["p0 as (select id, list_transform(v, lambda x: least(abs(x), 1.0)) as p from vec)", "s0 as (select list_transform(p, lambda x: 1.0::double) as rest from p0 limit 1)"]
    for n in range(k):
        taken = " union all ".join(f"select id from c{i}" for i in range(n)) or "select -1"
        steps += [
            f"c{n} as materialized (select id, p, {gain} as gain from p0, s{n} where id not in ({taken}) order by round({gain}, 12) desc, id limit 1)",
            f"s{n + 1} as materialized (select list_transform(range(1, len(p) + 1), lambda i: rest[i] * (1 - p[i])) as rest from c{n}, s{n})"]
    total = " + ".join(f"(select gain from c{n})" for n in range(k))
    return f"with {', '.join(steps)} " + " union all ".join(f"select id, {n} as step, round({total}, 6) as value from c{n}" for n in range(k))


@query("acq_greedy_coverage", _coverage_sql(8), "vec")
def acq_greedy_coverage(spark, sf):
    """Eight vectors that cover the 64 directions, each component's size as its success probability."""
    rows = T.vec(spark, sf).withColumn("p", F.transform("v", lambda x: F.least(F.abs(x), F.lit(1.0))))
    ids, value = A.greedy_coverage(rows, "id", "p", [1.0] * T.D, 8)
    return spark.createDataFrame([(i, n, round(value, 6)) for n, i in enumerate(ids)], "id bigint, step int, value double")


@query("acq_gaussian_information")
def acq_gaussian_information(spark, sf):
    value = A.gaussian_information(T.vec(spark, sf), "v", np.eye(T.D), 0.2)
    return spark.createDataFrame([(value,)], "information double")


@query("acq_greedy_information")
def acq_greedy_information(spark, sf):
    ids, value = A.greedy_information(T.vec(spark, sf), "id", "v", np.eye(T.D), 0.2, 12)
    return spark.createDataFrame([(i, n, value) for n, i in enumerate(ids)], "id bigint, step int, information double")


@query("acq_posterior_update")
def acq_posterior_update(spark, sf):
    """Posterior of a linear model of the label over all vectors."""
    rows = T.vec(spark, sf).withColumn("y", F.col("label").cast("double"))
    mean, covariance = A.posterior_update(rows, "v", "y", np.zeros(T.D), np.eye(T.D), 1.0)
    return spark.createDataFrame([(i, float(m), float(covariance[i, i])) for i, m in enumerate(mean)], "pos int, mean double, variance double")
