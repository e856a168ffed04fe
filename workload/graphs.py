"""Graphs, finite-catalog distributions and exploration mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions.keys import stable_bucket
from winnow.operators import catalog as K
from winnow.operators import graph as G
from winnow.plans.cut import cut
from winnow.plans.ordered import with_previous
from workload import tables as T
from workload.registry import query, r

DEALT = 2_000_000  # legal codes of a partition of a layout, 8 MB


def _edges(spark, sf):
    """Consecutive items of a user as weighted edges."""
    rows = with_previous(T.ev(spark, sf), ["user_id"], [F.col("timestamp"), F.col("event_id")], "item_id", 1, "prev")
    pairs = rows.filter(F.size("prev") == 1).select(F.col("prev")[0].alias("src"), F.col("item_id").alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


_EDGES = """pairs as (select lag(item_id) over (partition by user_id order by "timestamp", event_id) as src, item_id as dst from ev),
     edges as (select src, dst, cast(count(*) as double) as w from pairs where src is not null group by all),
     shares as (select src, dst, w / sum(w) over (partition by src) as p from edges)"""


@query(
    "grf_personalized_pagerank",
    f"""with recursive {_EDGES},
        nodes as (select item_id as node, count(*) * 1.0::double / (select count(*) from ev) as p from ev group by 1),
        walk(n, node, x) as (select 0, node, p from nodes union all
          select w.n, nodes.node, nodes.p + coalesce(w.s, 0.0) from
            (select walk.n + 1 as n, shares.dst as node, sum(0.5 * shares.p * walk.x) as s from walk join shares on shares.src = walk.node
             where walk.n < 50 group by 1, 2) w join nodes using (node))
        select node, round(x / (select sum(x) from walk where n = 50), 6) as rank from walk where n = 50""",
    "ev",
)
def grf_personalized_pagerank(spark, sf):
    ev = T.ev(spark, sf)
    n = ev.agg(F.count("*").alias("n")).select("n").scalar()
    restart = ev.groupBy(F.col("item_id").alias("node")).agg((F.count("*") / n).alias("p"))
    return G.personalized_pagerank(_edges(spark, sf), restart, 0.5, 1e-9).select("node", r("rank").alias("rank"))


@query(
    "grf_absorbing_value",
    f"""with recursive {_EDGES},
        reward as (select item_id as state, avg(value) as r from ev group by 1),
        walk(n, state, v) as (select 0, state, r from reward union all
          select w.n, reward.state, reward.r + w.s from
            (select walk.n + 1 as n, shares.src as state, sum(0.5 * shares.p * walk.v) as s from walk join shares on shares.dst = walk.state
             where walk.n < 60 group by 1, 2) w join reward using (state))
        select state, round(v, 4) as value from walk where n = 60""",
    "ev",
)
def grf_absorbing_value(spark, sf):
    edges = _edges(spark, sf)
    out = edges.groupBy("src").agg(F.sum("w").alias("t"))
    moves = edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p"))
    rewards = T.ev(spark, sf).groupBy(F.col("item_id").alias("state")).agg(F.avg("value").alias("r"))
    return G.absorbing_value(moves, rewards, 0.5, 1e-10).select("state", r("value", 4).alias("value"))


_USER = """u as (select user_id, domain, count(*) as n, avg(value) as lower from ev group by all),
     s as (select *, n * 1.0 / sum(n) over (partition by user_id) as base, 1.0 / count(*) over (partition by user_id) as explore from u)"""


def _user_shares(spark, sf):
    counts = T.ev(spark, sf).groupBy("user_id", "domain").agg(F.count("*").alias("n"), F.avg("value").alias("lower"))
    totals = counts.groupBy("user_id").agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    return counts.join(totals, "user_id").select(
        "user_id", "domain", "lower", (F.col("n") / F.col("t")).alias("base"), (F.lit(1.0) / F.col("k")).alias("explore")
    )


@query(
    "grf_safe_mixture",
    f"""with {_USER}, m as (select user_id, sum(base * lower) as b, sum(explore * lower) as e from s group by 1),
        x as (select user_id, case when b < 45 - 1e-12 then null when e < b then least(1.0, greatest(0.0, (b - 45) / (b - e))) else 1.0 end as eps from m)
        select user_id, domain, round(eps, 6) as epsilon, round((1 - eps) * base + eps * explore, 6) as q from s join x using (user_id)""",
    "ev",
)
def grf_safe_mixture(spark, sf):
    out = G.safe_mixture(_user_shares(spark, sf), ["user_id"], "base", "explore", "lower", 45.0)
    return out.select("user_id", "domain", r("epsilon").alias("epsilon"), r("q").alias("q"))


@query(
    "grf_kl_tilt",
    f"""with {_USER}, z as (select *, base * exp(lower / 100) as w from s)
        select user_id, domain, round(w / sum(w) over (partition by user_id), 6) as q from z""",
    "ev",
)
def grf_kl_tilt(spark, sf):
    return G.kl_tilt(_user_shares(spark, sf), ["user_id"], "base", "lower", 100.0).select("user_id", "domain", r("q").alias("q"))


@query(
    "grf_coverage_new",
    """with i as (select user_id, item_id, count(*) * 1.0 / sum(count(*)) over (partition by user_id) as p from ev group by user_id, item_id),
       seen as (select distinct user_id, item_id from ev where "timestamp" < 1705795200)
       select i.user_id, round(sum(case when seen.item_id is null then p else 0 end), 6) as mass from i left join seen using (user_id, item_id) group by 1""",
    "ev",
)
def grf_coverage_new(spark, sf):
    ev = T.ev(spark, sf)
    counts = ev.groupBy("user_id", "item_id").agg(F.count("*").alias("n"))
    totals = counts.groupBy("user_id").agg(F.sum("n").alias("t"))
    p = counts.join(totals, "user_id").select("user_id", "item_id", (F.col("n") / F.col("t")).alias("p"))
    seen = ev.filter(F.col("timestamp") < T.EVENT_TRAIN_END).select("user_id", "item_id")
    return G.coverage_new(p, seen, ["user_id"], "item_id", "p").select("user_id", r("mass").alias("mass"))


def _coded(spark, sf):
    """Parts with codes (brand, size, category bucket, suffix) and a price-proportional distribution."""
    items = T.cat(spark, sf).select(
        "item_id", "domain", F.expr("cast(substr(brand, 7) as int)").alias("c1"), F.col("size").alias("c2"), stable_bucket("category", 16).cast("int").alias("c3")
    )
    named = K.namespace_catalog(items, 0)
    prices = T.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("item_id"), "p_retailprice")
    total = prices.agg(F.sum("p_retailprice").alias("t")).select("t").scalar()
    return named.join(prices, "item_id").select(
        "item_id", "domain", F.array("c1", "c2", "c3", F.col("suffix").cast("int")).alias("codes"), (F.col("p_retailprice") / total).alias("q")
    )


_CODED = """c3 as (select p_partkey, cast(p_partkey as varchar) as item_id, cast(substr(p_brand, 7) as integer) as c1, p_size as c2,
       cast(cast('0x' || substr(sha256(p_type), 1, 12) as bigint) % 16 as integer) as c3, p_retailprice / (select sum(p_retailprice) from part) as q from part),
     coded as (select item_id, q, [c1, c2, c3, cast(row_number() over (partition by c1, c2, c3 order by item_id) - 1 as integer)] as codes from c3),
     steps as (select item_id, q, codes, unnest(range(len(codes) + 1)) as depth, unnest(list_append(codes, -1)) as token from coded),
     edges as (select list_slice(codes, 1, depth) as prefix, token, sum(q) as mass from steps group by all),
     law as (select prefix, token, mass / sum(mass) over (partition by prefix) as prob from edges)"""


@query(
    "grf_trie_next_distribution",
    f"with {_CODED} select array_to_string(prefix, '.') as prefix, token, round(prob, 9) as prob from law",
)
def grf_trie_next_distribution(spark, sf):
    out = K.trie_next_distribution(_coded(spark, sf))
    return out.select(F.array_join(F.col("prefix").cast("array<string>"), ".").alias("prefix"), "token", r("prob", 9).alias("prob"))


@query("grf_item_path_probability", f"with {_CODED} select item_id, round(q, 9) as path_probability from coded")
def grf_item_path_probability(spark, sf):
    """The oracle states the identity: the path probability is the item's own probability."""
    return K.item_path_probability(_coded(spark, sf)).select("item_id", r("path_probability", 9).alias("path_probability"))


_LAYOUT = f"""{_CODED}, s4 as (select item_id, depth, token as code, list_slice(codes, 1, depth) as prefix from steps where depth < 4),
     al as (select prefix, list_sort(list(distinct code)) as allowed from s4 group by prefix),
     lay as (select item_id, depth, code, allowed, list_position(allowed, code) - 1 as label from s4 join al using (prefix))"""


@query(
    "grf_legal_layout",
    f"with {_LAYOUT} select item_id, depth, code, array_to_string(allowed, ',') as allowed, label from lay",
)
def grf_legal_layout(spark, sf):
    out = K.legal_layout(_coded(spark, sf))
    return out.select(
        "item_id", F.col("depth").cast("bigint").alias("depth"), "code",
        F.array_join(F.col("allowed").cast("array<string>"), ",").alias("allowed"), "label",
    )


@query(
    "grf_catalog_violations",
    """with c as (select cast(p_partkey as varchar) as item_id, case when p_size > 45 then [p_size] when p_size < 3 then [-1, p_size] else [p_size, length(p_name)] end as codes from part),
       s as (select item_id, codes, array_to_string(codes, ',') as seq from c)
       select item_id as key, 'eos_inside' as rule from s where list_contains(codes, -1)
       union all select item_id, 'code_count' from s where len(codes) <> 2
       union all select seq, 'duplicate_sequence' from s group by seq having count(*) > 1""",
)
def grf_catalog_violations(spark, sf):
    size = F.col("p_size")
    rows = T.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("item_id"),
        F.when(size > 45, F.array(size)).when(size < 3, F.array(F.lit(-1), size)).otherwise(F.array(size, F.length("p_name"))).alias("codes"),
    )
    return K.catalog_violations(rows, 2)


@query(
    "grf_restricted_logprob",
    f"""with {_LAYOUT}, lg as (select item_id, depth, code as true_code, unnest(allowed) as code from lay),
        z as (select item_id, depth, true_code, code, ((code * 7 + depth * 3) % 10) / 10.0 as logit from lg),
        st as (select item_id, depth, sum(case when code = true_code then logit end) - ln(sum(exp(logit))) as step from z group by all)
        select item_id, round(sum(step), 6) as logprob, round(-avg(step), 6) as loss from st group by item_id""",
)
def grf_restricted_logprob(spark, sf):
    """Logits also cover codes that are not legal at the prefix; they must not enter the normaliser."""
    layout = cut(K.legal_layout(_coded(spark, sf)))
    # Logits are made where the layout of their item lies: only the layout is dealt, its codes bounded by partition.
    codes = layout.agg(F.sum(F.size("allowed")).alias("n")).first()["n"] or 0
    layout = layout.repartition(max(spark.sparkContext.defaultParallelism, -(-codes // DEALT)), "domain", "item_id", "depth")
    logits = layout.select(
        F.col("item_id").alias("record_id"), "domain", "item_id", "depth",
        F.explode(F.concat("allowed", F.array(F.lit(9001), F.lit(9002)))).alias("code"),
    ).withColumn("logit", ((F.col("code") * 7 + F.col("depth") * 3) % 10) / 10.0)
    out = K.restricted_logprob(logits, layout, ["record_id"])
    return out.select(F.col("record_id").alias("item_id"), r("logprob").alias("logprob"), r("loss").alias("loss"))


@query(
    "grf_speculative_identity",
    """with n as (select user_id, domain, count(*) as n, sum(value) as v from ev group by all),
       p as (select user_id, domain, n * 1.0 / sum(n) over w as t, v / sum(v) over w as d from n window w as (partition by user_id)),
       s as (select user_id, sum(least(t, d)) as acc, sum(greatest(t - d, 0)) as res from p group by 1)
       select user_id, domain, round(least(t, d) + case when 1 - acc < 1e-14 then 0 else (1 - acc) * greatest(t - d, 0) / res end, 6) as output, round(acc, 6) as acceptance
       from p join s using (user_id)""",
    "ev",
)
def grf_speculative_identity(spark, sf):
    from workload.rankings import _target_and_draft

    rows = _target_and_draft(spark, sf)
    target = rows.select("user_id", "domain", F.col("target").alias("p"))
    draft = rows.select("user_id", "domain", F.col("draft").alias("p"))
    out = G.speculative_identity(target, draft, ["user_id"], "domain")
    return out.select("user_id", "domain", r("output").alias("output"), r("acceptance").alias("acceptance"))
