"""Sampling, simple rankers, ranking metrics and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.operators import ranking as M
from winnow.operators import sampling as S
from winnow.operators.history import with_history
from winnow.plans.cut import cut
from workload import tables as T
from workload.registry import query, r


@query(
    "smp_root_reservoir",
    """with roots as (select distinct user_id from buy), top as (select user_id from roots order by sha256('42|' || user_id) limit 200)
       select event_id, user_id from buy where user_id in (select user_id from top)""",
    "buy",
)
def smp_root_reservoir(spark, sf):
    return S.root_reservoir(cut(T.buy(spark, sf)), "user_id", 200, 42).select("event_id", "user_id")


@query(
    "smp_stratified_sample",
    """select event_id, domain from ev qualify row_number() over (partition by domain order by sha256('5|' || event_id)) <= 50""",
    "ev",
)
def smp_stratified_sample(spark, sf):
    return S.stratified_sample(T.ev(spark, sf), ["domain"], "event_id", 50, 5).select("event_id", "domain")


def _uniform(seed: str, key: str) -> str:
    """The number in (0, 1) that the library draws for a key."""
    return f"((cast('0x' || substr(sha256('{seed}|' || {key}), 1, 12) as bigint) + cast(0.5 as double)) / pow(2, 48))"


def _draws(key: str, source: str, draws: int, seed: int) -> str:
    """Tables up to `hit`: the key of every draw, from whole-numbered adjoining intervals over source(key, p)."""
    return f"""mass as (select {key}, cast(round(p * pow(2, 52)) as bigint) as m from {source}),
        ends as (select {key}, m, cast(sum(m) over (order by {key}) as bigint) as hi from mass),
        place as (select id as draw, cast(floor({_uniform(str(seed), "cast(id as varchar)")} * (select max(hi) from ends)) as bigint) as u from range({draws}) t(id)),
        hit as (select draw, {key} from place join ends on u >= hi - m and u < hi)"""


@query(
    "smp_weighted_draws",
    f"""with l as (select l_partkey, sum(l_extendedprice) as w from lineitem group by 1), d as (select l_partkey, w / (select sum(w) from l) as p from l),
        {_draws("l_partkey", "d", 20000, 11)}, n as (select l_partkey, count(*) as n from hit group by 1)
        select l_partkey, round(p, 9) as p, coalesce(n, 0) / cast(20000 as double) as frequency from d left join n using (l_partkey)""",
)
def smp_weighted_draws(spark, sf):
    """Draw items in proportion to their line value; compare frequency and probability."""
    lines = T.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("w"))
    total = lines.agg(F.sum("w").alias("t")).select("t").scalar()
    dist = lines.select("l_partkey", (F.col("w") / total).alias("p"))
    draws = S.weighted_draws(dist, "l_partkey", "p", 20000, 11)
    seen = draws.groupBy("l_partkey").agg((F.count("*") / F.lit(20000.0)).alias("frequency"))
    return dist.withColumn("p", r("p", 9)).join(seen, "l_partkey", "left").na.fill({"frequency": 0.0})


@query(
    "smp_two_stage_draws",
    f"""with d as (select event_id, domain, cast(1 as double) / ((select count(distinct domain) from ev) * count(*) over (partition by domain)) as p from ev),
        {_draws("event_id", "d", 5000, 3)} select domain, count(*) as draws from hit join ev using (event_id) group by domain""",
    "ev",
)
def smp_two_stage_draws(spark, sf):
    rows = T.ev(spark, sf)
    draws = S.two_stage_draws(rows, "domain", "event_id", 5000, 3)
    return draws.join(rows.select("event_id", "domain"), "event_id").groupBy("domain").agg(F.count("*").alias("draws"))


_QUERIES = """q as (select domain || ':' || user_id as query_id, domain, user_id, item_id as target,
        list_reverse(list_transform(history, lambda x: x.i)) as predictions, history from ehist
      qualify row_number() over (partition by domain, user_id order by "timestamp" desc, event_id desc) = 1),
    known as (select distinct domain, item_id from ev where "timestamp" < 1705795200),
    pop as (select domain, list(item_id order by n desc, item_id) as popular from
      (select domain, item_id, count(*) as n from ev where "timestamp" < 1705795200 group by all) group by domain)"""


def ranking_queries(spark, sf):
    """The last event of each (domain, user): its history, newest first, as the predictions."""
    events = cut(T.ev(spark, sf))
    last = events.groupBy("domain", "user_id").agg(F.max(F.struct("timestamp", "event_id")).alias("m")).select("m.event_id")
    # The semi join is pushed below the join that returns histories, so only the queried events carry one.
    return with_history(events, 20).join(last, "event_id", "left_semi").select(
        F.concat("domain", F.lit(":"), "user_id").alias("query_id"), "domain", "user_id",
        F.lit("recommendation").alias("task"), F.array("item_id").alias("targets"), F.col("item_id").alias("target"),
        T.items().alias("history"),
    ).withColumn("predictions", F.reverse("history"))


def train_events(spark, sf):
    return T.ev(spark, sf).filter(F.col("timestamp") < T.EVENT_TRAIN_END)


_PER_QUERY = """slots as (select query_id, domain, target, unnest(list_slice(predictions, 1, 10)) as item_id,
        unnest(range(1, least(len(predictions), 10) + 1)) as pos from q),
    flagged as (select s.*, row_number() over (partition by query_id, s.item_id order by pos) = 1 and k.item_id is not null as valid
      from slots s left join known k on k.domain = s.domain and k.item_id = s.item_id),
    per as (select q.query_id, q.domain,
        max(case when valid and f.item_id = q.target then 1.0::double else 0.0::double end) as recall,
        coalesce(sum(case when valid and f.item_id = q.target then 1.0 / log2(pos + 1) end), 0.0) as ndcg,
        count(case when not valid then 1 end) as invalid_slots, count(pos) as returned_slots
      from q left join flagged f on f.query_id = q.query_id group by q.query_id, q.domain)"""


@query(
    "met_ranking_per_query",
    f"""with {_QUERIES}, {_PER_QUERY} select query_id, recall, round(ndcg, 6) as ndcg, invalid_slots, returned_slots from per""",
    "ehist ev",
)
def met_ranking_per_query(spark, sf):
    """Raw histories as predictions against the training catalog: repeats and illegal items occur."""
    per = M.ranking_per_query(ranking_queries(spark, sf), train_events(spark, sf).select("domain", "item_id"), 10)
    return per.select("query_id", r("recall").alias("recall"), r("ndcg").alias("ndcg"), "invalid_slots", "returned_slots")


@query(
    "met_ranking_summary",
    f"""with {_QUERIES}, {_PER_QUERY},
        g as (select domain, count(*) as n, avg(recall) as re, avg(ndcg) as nd, sum(invalid_slots) as inv, sum(returned_slots) as ret from per group by domain)
        select 'group' as level, domain, n as queries, round(re, 6) as recall, round(nd, 6) as ndcg, round(inv / greatest(ret, 1), 6) as invalid_rate from g
        union all select 'micro', '*', sum(n)::bigint, round(sum(re * n) / sum(n), 6), round(sum(nd * n) / sum(n), 6), round(sum(inv) / greatest(sum(ret), 1), 6) from g
        union all select 'macro', '*', sum(n)::bigint, round(avg(re), 6), round(avg(nd), 6), round(sum(inv) / greatest(sum(ret), 1), 6) from g""",
    "ehist ev",
)
def met_ranking_summary(spark, sf):
    """Histories, time split, recent history as recommender, ranking metrics: the minimum slice."""
    per = M.ranking_per_query(ranking_queries(spark, sf), train_events(spark, sf).select("domain", "item_id"), 10)
    out = M.ranking_summary(per)
    return out.select("level", "domain", "queries", r("recall").alias("recall"), r("ndcg").alias("ndcg"), r("invalid_rate").alias("invalid_rate"))


@query(
    "met_query_violations",
    """with q as (select e.domain || ':' || user_id as query_id, domain, item_id from ev e),
         known as (select distinct domain, item_id from ev where domain <> 'error' and "timestamp" < 1705795200)
       select query_id, 'duplicate_query' as rule from q group by 1 having count(*) > 1
       union all select query_id, 'unknown_domain' from q where domain not in (select domain from known)
       union all select distinct query_id, 'target_outside_catalog' from q where (domain, item_id) not in (select domain, item_id from known)""",
    "ev",
)
def met_query_violations(spark, sf):
    rows = T.ev(spark, sf).select(
        F.concat("domain", F.lit(":"), "user_id").alias("query_id"), "domain", F.array("item_id").alias("targets")
    )
    catalog = train_events(spark, sf).filter("domain <> 'error'").select("domain", "item_id")
    return M.query_violations(rows, catalog)


@query(
    "met_rank_metrics",
    f"""with {_QUERIES}, k as (select case when list_position(predictions, target) > 0 then list_position(predictions, target) end as rk from q)
        select count(*) as n, round(avg(case when rk <= 10 then 1.0 else 0.0 end), 6) as recall_10,
          round(avg(case when rk <= 10 then 1.0 / log2(rk + 1) else 0.0 end), 6) as ndcg_10,
          round(avg(case when rk <= 20 then 1.0 else 0.0 end), 6) as recall_20,
          round(avg(case when rk <= 20 then 1.0 / log2(rk + 1) else 0.0 end), 6) as ndcg_20 from k""",
    "ehist ev",
)
def met_rank_metrics(spark, sf):
    out = M.rank_metrics(ranking_queries(spark, sf), "target", "predictions")
    return out.select("n", *[r(c).alias(c) for c in out.columns if c != "n"])


@query("met_paired_bootstrap")
def met_paired_bootstrap(spark, sf):
    """Recent history against last item then popularity, 2,000 resamples."""
    return _paired(spark, sf)


def _paired(spark, sf):
    rows = cut(ranking_queries(spark, sf))
    left = M.history_then_popularity(rows, train_events(spark, sf), 10)
    right = M.history_then_popularity(rows, train_events(spark, sf), 10, depth=1)
    return M.paired_bootstrap(
        M.ranks_table(left, "query_id", "target", "predictions"), M.ranks_table(right, "query_id", "target", "predictions")
    )


def _gain_sql(name: str, past: str) -> str:
    """Tables up to `name`: the NDCG@10 of a ranker for every query."""
    return f"""{name}_all as (select query_id, target, list_concat({past}, coalesce(popular, [])) as l from q left join pop using (domain)),
        {name}_pos as (select query_id, target, unnest(l) as i, unnest(range(len(l))) as pos from {name}_all),
        {name}_first as (select query_id, i, i = target as hit, min(pos) as pos from {name}_pos group by all),
        {name}_rank as (select query_id, hit, row_number() over (partition by query_id order by pos) as rk from {name}_first),
        {name} as (select query_id, coalesce(max(case when hit and rk <= 10 then 1.0 / log2(rk + 1) end), 0.0) as g from q left join {name}_rank using (query_id) group by query_id)"""


@query(
    "met_paired_difference",
    f"""with {_QUERIES}, {_gain_sql("a", "predictions")}, {_gain_sql("b", "list_slice(predictions, 1, 1)")}
        select count(*) as records, round(avg(a.g - b.g), 6) + 0.0 as difference, true as inside from a join b using (query_id)""",
    "ehist ev",
)
def met_paired_difference(spark, sf):
    """The same comparison, and that its interval holds the difference."""
    inside = (F.col("low") <= F.col("difference")) & (F.col("difference") <= F.col("high"))
    return _paired(spark, sf).select("records", r("difference").alias("difference"), inside.alias("inside"))


@query(
    "met_popularity_ranker",
    f"""with {_QUERIES} select domain, array_to_string(list_slice(popular, 1, 10), ',') as popular from pop""",
    "ehist ev",
)
def met_popularity_ranker(spark, sf):
    return M.popularity_ranker(train_events(spark, sf), 10).select("domain", F.array_join("popular", ",").alias("popular"))


def _ranker_sql(past: str) -> str:
    return f"""with {_QUERIES}, al as (select query_id, list_concat({past}, coalesce(popular, [])) as l from q left join pop using (domain)),
        un as (select query_id, unnest(l) as i, unnest(range(len(l))) as pos from al),
        fst as (select query_id, i, min(pos) as pos from un group by all)
        select query_id, array_to_string(list_slice(list(i order by pos), 1, 10), ',') as predictions from fst group by query_id"""


@query("met_last_item_then_popularity", _ranker_sql("list_slice(predictions, 1, 1)"), "ehist ev")
def met_last_item_then_popularity(spark, sf):
    out = M.history_then_popularity(ranking_queries(spark, sf), train_events(spark, sf), 10, depth=1)
    return out.select("query_id", F.array_join("predictions", ",").alias("predictions"))


@query("met_recent_history_then_popularity", _ranker_sql("predictions"), "ehist ev")
def met_recent_history_then_popularity(spark, sf):
    out = M.history_then_popularity(ranking_queries(spark, sf), train_events(spark, sf), 10)
    return out.select("query_id", F.array_join("predictions", ",").alias("predictions"))


@query(
    "met_method_summary",
    """select o_orderpriority as method, count(*) as runs, round(avg(o_totalprice), 4) as o_totalprice_mean,
         round(stddev_samp(o_totalprice), 4) as o_totalprice_std from orders group by 1""",
)
def met_method_summary(spark, sf):
    out = M.method_summary(T.table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "method"), "method", ["o_totalprice"])
    return out.select("method", "runs", r("o_totalprice_mean", 4).alias("o_totalprice_mean"), r("o_totalprice_std", 4).alias("o_totalprice_std"))


@query(
    "met_cost_comparison",
    """with t as (select l_returnflag || l_linestatus as method, sum(l_quantity) + sum(l_discount) + sum(l_tax) as total from lineitem group by 1)
       select method, round(total, 4) as total_seconds, round(total / (select total from t where method = 'NO') - 1, 6) as overhead from t""",
)
def met_cost_comparison(spark, sf):
    runs = T.table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("method"), F.col("l_quantity").alias("train_seconds"),
        F.col("l_discount").alias("selection_seconds"), F.col("l_tax").alias("representation_seconds"),
    )
    out = M.cost_comparison(runs, "method", "NO")
    return out.select("method", r("total_seconds", 4).alias("total_seconds"), r("overhead").alias("overhead"))


@query(
    "met_best_run",
    """with p as (select o_orderpriority, max(o_totalprice) as a, max(-o_custkey) as b from orders group by 1)
       select o_orderpriority as method,
         min(case when o_totalprice >= a - 1e-12 then o_orderkey end) as best_by_primary,
         min(case when -o_custkey >= b - 1e-12 then o_orderkey end) as best_by_worst
       from orders join p using (o_orderpriority) group by 1""",
)
def met_best_run(spark, sf):
    stages = T.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("method"), "o_orderkey", F.col("o_totalprice").alias("primary"),
        (-F.col("o_custkey")).cast("double").alias("worst"),
    )
    return M.best_run(stages, "method", "o_orderkey", ["primary", "worst"], "o_orderkey")


@query(
    "met_window_diagnostics",
    """select o_orderpriority as method, count(*) as windows, count(case when o_totalprice - 250000 <= 0 then 1 end) as nonpositive,
         round(avg(o_custkey), 6) as mean_mass from orders group by 1""",
)
def met_window_diagnostics(spark, sf):
    rows = T.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("method"), (F.col("o_totalprice") - 250000).alias("response"), F.col("o_custkey").alias("mass")
    )
    out = M.window_diagnostics(rows, "method", "response", "mass")
    return out.withColumn("nonpositive", F.col("nonpositive").cast("bigint")).withColumn("mean_mass", r("mean_mass"))


@query(
    "smp_hard_negatives",
    f"""with {_QUERIES}, c as (select query_id, unnest(predictions) as item_id, unnest(range(len(predictions))) as rk from q),
        best as (select c.query_id, arg_min(item_id, rk) as b from c join q using (query_id) where item_id <> target group by 1),
        spare as (select domain, list_slice(list_sort(list(distinct item_id)), 1, 2) as two from ev group by domain)
        select query_id as record_id, coalesce(b, case when two[1] <> target then two[1] else two[2] end) as negative
        from q left join best using (query_id) left join spare using (domain)""",
    "ehist ev",
)
def smp_hard_negatives(spark, sf):
    rows = ranking_queries(spark, sf)
    positives = rows.select(F.col("query_id").alias("record_id"), "domain", F.col("target").alias("answer"))
    candidates = rows.select(F.col("query_id").alias("record_id"), F.posexplode("predictions").alias("rank", "item_id"))
    return S.hard_negatives(positives, candidates, T.ev(spark, sf).select("domain", "item_id"))


@query(
    "smp_categorical_pick",
    f"""with c as (select user_id, item_id, count(*) as n from ev group by all), p as (select *, n / cast(sum(n) over (partition by user_id) as double) as p from c)
        select user_id, arg_max(item_id, ln(p) - ln(-ln({_uniform("9", "user_id || '|' || item_id")}))) as pick from p group by user_id""",
    "ev",
)
def smp_categorical_pick(spark, sf):
    """One item per user in proportion to how often the user had it."""
    counts = T.ev(spark, sf).groupBy("user_id", "item_id").agg(F.count("*").alias("n"))
    totals = counts.groupBy("user_id").agg(F.sum("n").alias("t"))
    p = counts.join(totals, "user_id").select("user_id", "item_id", (F.col("n") / F.col("t")).alias("p"))
    return S.categorical_pick(p, ["user_id"], "item_id", "p", 9)


def _target_and_draft(spark, sf):
    counts = T.ev(spark, sf).groupBy("user_id", "domain").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    totals = counts.groupBy("user_id").agg(F.sum("n").alias("tn"), F.sum("v").alias("tv"))
    return counts.join(totals, "user_id").select(
        "user_id", "domain", (F.col("n") / F.col("tn")).alias("target"), (F.col("v") / F.col("tv")).alias("draft")
    )


_NOISE = {k: f"ln(-ln({_uniform('13-' + k, "user_id || '|' || domain")}))" for k in ("draft", "rest")}


@query(
    "smp_speculative_pick",
    f"""with c as (select user_id, domain, count(*) as n, sum(value) as v from ev group by all),
          p as (select user_id, domain, n / cast(sum(n) over w as double) as t, v / sum(v) over w as d from c window w as (partition by user_id)),
          k as (select user_id, arg_max({{'i': domain, 't': t, 'd': d}}, case when d > 0 then ln(d) - {_NOISE["draft"]} end) as pick,
                  arg_max(domain, case when t > d then ln(greatest(t - d, 1e-300)) - {_NOISE["rest"]} end) as other from p group by user_id),
          a as (select *, {_uniform("13-accept", "user_id")} * pick.d < pick.t or other is null as accepted from k)
        select user_id, case when accepted then pick.i else other end as pick, accepted from a""",
    "ev",
)
def smp_speculative_pick(spark, sf):
    return S.speculative_pick(_target_and_draft(spark, sf), ["user_id"], "domain", "target", "draft", 13)


@query(
    "smp_base_distribution",
    """select domain, round(sum(p), 9) as mass, round(min(p), 12) as p from
         (select domain, 1.0 / (select count(distinct domain) from ev) / count(*) over (partition by domain) as p from ev) group by domain""",
    "ev",
)
def smp_base_distribution(spark, sf):
    p = S.base_distribution(T.ev(spark, sf), "domain", "equal_domains")
    return p.groupBy("domain").agg(r(F.sum("p"), 9).alias("mass"), r(F.min("p"), 12).alias("p"))
