"""Budgeted selection, refill, exposure plans and response queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions.keys import seeded, stable_bucket
from winnow.operators import exposure as X
from winnow.operators import refill as R
from winnow.operators import selection as S
from winnow.plans.cut import cut
from workload import tables as T
from workload.registry import query, r


def pool(spark, sf):
    """Vectors as a pool: coordinates, cost, cell (label), provenance group and a utility."""
    return T.vec(spark, sf).select(
        "id", F.col("v").alias("z"), "cost", "cell", F.concat("cell", F.lit("/"), "grp").alias("grp"),
        (F.element_at("v", 1) + F.element_at("v", 2)).alias("utility"),
    )


@query("sel_budgeted_full_code")
def sel_budgeted_full_code(spark, sf):
    """Coverage and utility per token with quotas in two cells and a provenance cap."""
    config = S.SelectConfig(
        budget=160, coverage_weight=1.0, utility_weight=0.2, min_rows={"0": 5, "1": 4}, max_rows={"2": 2}, provenance_cap=1, block=32
    )
    chosen, _ = S.budgeted_select(pool(spark, sf), config)
    return chosen


def _walk(key: str, where: str = "true") -> str:
    """A walk over the pool in descending order of a key: a row is taken if it still fits the budget of 400."""
    return f"""with recursive o as (select id, cost, v[1] + v[2] as utility, row_number() over (order by {key} desc, id) as k from vec where {where}),
         w as (select cast(0 as bigint) as k, 400 as room, cast(null as bigint) as id, false as taken
           union all select o.k, case when o.cost <= w.room then w.room - o.cost else w.room end, o.id, o.cost <= w.room from w join o on o.k = w.k + 1)"""


_DRAWN = "round((cast('0x' || substr(sha256({seed} || '|' || id), 1, 12) as bigint) + 0.5::double) / 281474976710656::double, 12)"
_DENSITY = "round((v[1] + v[2]) / cost, 12)"


@query("sel_budgeted_random", _walk(_DRAWN.format(seed=3)) + " select id, cost from w join o using (id) where taken", "vec")
def sel_budgeted_random(spark, sf):
    return S.ordered_select(pool(spark, sf), 400, "random", 3).select("id", "cost")


@query(
    "sel_budgeted_utility",
    _walk(_DENSITY, f"{_DENSITY} > 0") + " select id, cost, round(utility, 6) as utility from w join o using (id) where taken", "vec")
def sel_budgeted_utility(spark, sf):
    return S.ordered_select(pool(spark, sf), 400, "utility").select("id", "cost", r("utility").alias("utility"))


def _quota_config(coverage: float) -> S.SelectConfig:
    return S.SelectConfig(
        budget=160, coverage_weight=coverage, utility_weight=0.2, min_rows={"0": 5, "1": 4}, max_rows={"2": 2}, provenance_cap=1, block=32,
        stop_nonpositive=False)


def _quota_walk(key: str) -> str:
    """The written rule of a selection whose densities do not change, one row after another.

    A row is taken if budget, upper quota and cap allow it and what the lower quotas still need can be paid for
    after it: the cheapest row of every group that is not used yet, as many as are missing.
    """
    need = " + ".join(
        f"""coalesce(list_sum(list_sort((select coalesce(list(c), []) from (select min(q.cost) as c from p q where q.cell = '{cell}'
              and q.grp <> o.grp and not list_contains(w.groups, q.grp) group by q.grp)))[1 : greatest({n} - len(list_filter(w.cells, lambda x: x = '{cell}'))
              - case when o.cell = '{cell}' then 1 else 0 end, 0)]), 0)""" for cell, n in (("0", 5), ("1", 4)))
    return f"""with recursive p as (select id, cost, cell, cell || '/' || grp as grp, v, v[1] + v[2] as utility from vec),
         o as (select *, row_number() over (order by {key} desc, id) as k from p),
         w as (select cast(0 as bigint) as k, cast(160 as bigint) as room, cast([] as varchar[]) as cells, cast([] as varchar[]) as groups, cast(null as bigint) as id,
             false as taken
           union all select k, case when fits then room - cost else room end, case when fits then list_append(cells, cell) else cells end,
             case when fits then list_append(groups, grp) else groups end, id, fits from (
               select o.k, o.id, o.cost, o.cell, o.grp, w.room, w.cells, w.groups,
                 o.cost <= w.room and not list_contains(w.groups, o.grp)
                   and (o.cell <> '2' or len(list_filter(w.cells, lambda x: x = '2')) < 2) and o.cost + {need} <= w.room as fits
               from w join o on o.k = w.k + 1)),
         t as (select id, row_number() over (order by k) as rank from w where taken)
       select t.id, t.rank, p.cost, p.cell, p.grp from t join p using (id)"""


@query("sel_quota_random", _quota_walk(_DRAWN.format(seed=42)), "vec")
def sel_quota_random(spark, sf):
    """Random order under quotas and a provenance cap."""
    return S.budgeted_select(pool(spark, sf), _quota_config(1.0), "random")[0]


@query("sel_quota_utility", _quota_walk("round(0.2 * (v[1] + v[2]) / cost, 12)"), "vec")
def sel_quota_utility(spark, sf):
    """Utility per token under quotas and a provenance cap, through the lazy rounds."""
    return S.budgeted_select(pool(spark, sf), _quota_config(0.0), "full_code")[0]


@query(
    "sel_quota_feasibility",
    """with g as (select *, row_number() over (partition by cell || '/' || grp order by cost, id) as g from vec),
       c as (select *, row_number() over (partition by cell order by cost, id) as rn from g where g <= 1),
       n as (select cell, count(*) as available, case when cell = '0' then 7 when cell = '1' then 5 when cell = '2' then count(*) else 0 end as need from vec group by cell)
       select n.cell, available, need, count(rn) as reachable, cast(coalesce(sum(cost), 0) as bigint) as cost
       from n left join c on c.cell = n.cell and rn <= need group by n.cell, available, need""",
    "vec",
)
def sel_quota_feasibility(spark, sf):
    config = S.SelectConfig(budget=500, min_rows={"0": 7, "1": 5}, protected=("2",), provenance_cap=1)
    return S.quota_feasibility(pool(spark, sf), config)


@query("sel_coverage_objective")
def sel_coverage_objective(spark, sf):
    """Information of the whole pool."""
    value = S.coverage_objective(pool(spark, sf), "z", T.D)
    return spark.createDataFrame([(value,)], "coverage double")


@query(
    "sel_keep_all_check",
    """select (sum(cost) <= 1000000 and (select max(n) from (select count(*) as n from vec group by cell, grp)) <= 5) as fits,
         count(*) as "rows", cast(sum(cost) as bigint) as tokens from vec""",
    "vec",
)
def sel_keep_all_check(spark, sf):
    return S.keep_all_check(pool(spark, sf), S.SelectConfig(budget=1_000_000, provenance_cap=5))


def lines_pool(spark, sf):
    """Line items as a refill pool: cell, cost, score and a hash-drawn selection."""
    rows = T.buy(spark, sf).join(T.cat(spark, sf).select("item_id", "category", "size"), "item_id")
    key = F.conv(F.substring("event_id", 1, 12), 16, 10).cast("bigint")
    return rows.select(
        key.alias("id"), ((key % 100003) / 1000.0).alias("score"), (F.col("size") % 5 + 1).cast("bigint").alias("cost"),
        F.col("category").alias("cell"), F.col("user_id").alias("grp"), (key % 3 == 0).alias("selected"),
    )


_LINES = """l as (select cast('0x' || substr(event_id, 1, 12) as bigint) as id, category as cell, size % 5 + 1 as cost, user_id as grp
       from buy join cat using (item_id)),
     p as (select *, (id % 100003) / 1000.0 as score, id % 3 = 0 as selected from l)"""


@query(
    "sel_refill",
    f"""with {_LINES}, i as (select *, row_number() over (partition by cell, cost order by score desc, id) as k from p where not selected),
        o as (select *, row_number() over (partition by cell, cost order by score, id) as k from p where selected)
        select i.id as id_in, o.id as id_out, round(i.score - o.score, 6) as gain from i join o using (cell, cost, k)
        where i.score > o.score order by i.score desc, i.id limit 500""",
    "buy cat",
)
def sel_refill(spark, sf):
    return R.refill(lines_pool(spark, sf), 500).select("id_in", "id_out", r("gain").alias("gain"))


@query(
    "sel_random_refill",
    f"""with {_LINES}, h as (select *, sha256('9-in|' || id) as hi, sha256('9-out|' || id) as ho from p),
        i as (select *, row_number() over (partition by cell, cost order by hi) as k from h where not selected),
        o as (select *, row_number() over (partition by cell, cost order by ho) as k from h where selected)
        select i.id as id_in, o.id as id_out, round(i.score - o.score, 6) as gain from i join o using (cell, cost, k) order by i.hi limit 300""",
    "buy cat",
)
def sel_random_refill(spark, sf):
    return R.random_refill(lines_pool(spark, sf), 300, 9).select("id_in", "id_out", r("gain").alias("gain"))


@query("sel_refill_capped")
def sel_refill_capped(spark, sf):
    """The sequential rule under a provenance cap of 30 rows per customer."""
    return R.refill(lines_pool(spark, sf), 200, cap=30).select("id_in", "id_out", r("gain").alias("gain"))


def _coded(spark, sf):
    """Three codes per event: the largest decides its atom."""
    h = [stable_bucket(F.concat(F.lit(f"c{j}|"), "event_id"), 1000) for j in range(3)]
    code = F.array(*[F.struct(F.lit(j).alias("atom"), (h[j].cast("double") * (3 - j) - 700.0).alias("w")) for j in range(3)])
    return T.ev(spark, sf).select(
        F.col("event_id").cast("bigint").alias("id"), code.alias("code"), F.col("value").alias("loss"), F.col("domain").alias("stratum"),
        (F.col("user_id") == "8").alias("user"), (F.col("value") > 1).alias("quality"),
    )


_RULE = """c as (select cast(event_id as bigint) as id, domain as stratum, value as loss, user_id = '8' as usr, sha256('42|' || event_id) as h,
       [(cast('0x' || substr(sha256('c0|' || event_id), 1, 12) as bigint) % 1000) * 3.0 - 700.0,
        (cast('0x' || substr(sha256('c1|' || event_id), 1, 12) as bigint) % 1000) * 2.0 - 700.0,
        (cast('0x' || substr(sha256('c2|' || event_id), 1, 12) as bigint) % 1000) * 1.0 - 700.0] as w from ev where value > 1),
     r as (select *, greatest(abs(w[1]), abs(w[2]), abs(w[3])) as weight,
       case when abs(w[1]) >= greatest(abs(w[2]), abs(w[3])) then 0 when abs(w[2]) >= abs(w[3]) then 1 else 2 end as atom from c),
     n as (select atom, count(*) as n, count(case when usr then 1 end) as forced, quantile_cont(loss, 0.2) as lo, quantile_cont(loss, 0.8) as hi from r group by atom),
     pl as (select *, cast(round_even(greatest(0, 800 - forced) * 0.2, 0) as bigint) as heavy from n),
     small as (select r.id, r.atom from r join pl using (atom) where n <= 800),
     forced as (select r.id, r.atom from r join pl using (atom) where n > 800 and usr),
     rest as (select r.*, pl.forced, pl.heavy, lo, hi from r join pl using (atom) where n > 800 and not usr),
     top as (select * from rest qualify row_number() over (partition by atom order by round(weight, 12) desc, id) <= 2 * heavy),
     heavies as (select id, atom from top qualify row_number() over (partition by atom order by h) <= heavy),
     mid as (select * from rest where loss between lo and hi and id not in (select id from heavies)),
     turns as (select *, row_number() over (partition by atom, stratum order by h) as turn from mid),
     lined as (select *, row_number() over (partition by atom order by turn, sha256('42|' || stratum), id) as rn from turns),
     took as (select atom, count(*) as k from heavies group by atom),
     filled as (select lined.id, lined.atom from lined join took using (atom) where rn <= greatest(800, forced) - forced - k)"""


@query(
    "sel_rule_select",
    f"with {_RULE} select id, atom, 'all' as reason from small union all select id, atom, 'user' from forced union all select id, atom, 'weight' from heavies union all select id, atom, 'turn' from filled",
    "ev",
)
def sel_rule_select(spark, sf):
    return X.rule_select(_coded(spark, sf))


def _selected(spark, sf):
    return T.sft(spark, sf).filter("split = 'train'").select(
        F.col("record_id").alias("id"), "cost", F.size("input_ids").alias("input_tokens"), "content_id", "cell"
    )


@query("sel_exposure_schedule")
def sel_exposure_schedule(spark, sf):
    """Two and a half epochs of the training records."""
    rows = _selected(spark, sf)
    total = rows.agg(F.sum("cost").alias("s")).first()["s"]
    plan = X.exposure_schedule(rows, int(total * 2.5), 10, 4)
    return plan.select("occurrence_id", "id", "epoch", "cost")


@query(
    "sel_schedule_report",
    """with s as (select *, sum(cost) over () as total from sft where split = 'train'), p as (select * from s, range(3))
       select cast(sum(cost) as bigint) as tokens, count(*) as occurrences, count(distinct record_id) as unique_records, cast(sum(len(input_ids)) as bigint) as input_tokens,
         round(1 - count(distinct record_id) * 1.0 / count(*), 6) as duplicate_fraction, cast(0 as bigint) as unused from p""",
    "sft",
)
def sel_schedule_report(spark, sf):
    """A plan of exactly three epochs uses its budget up."""
    rows = _selected(spark, sf)
    budget = 3 * int(rows.agg(F.sum("cost").alias("s")).first()["s"])
    out = X.schedule_report(X.exposure_schedule(rows, budget, 10, 4), budget)
    return out.select("tokens", "occurrences", "unique_records", "input_tokens", r("duplicate_fraction").alias("duplicate_fraction"), F.col("unused").cast("bigint").alias("unused"))


@query(
    "sel_schedule_report_by_cell",
    """select domain, cast(2 * sum(cost) as bigint) as tokens, 2 * count(*) as occurrences, count(*) as unique_records from sft where split = 'train' group by domain""",
    "sft",
)
def sel_schedule_report_by_cell(spark, sf):
    rows = T.sft(spark, sf).filter("split = 'train'").select(F.col("record_id").alias("id"), "cost", F.size("input_ids").alias("input_tokens"), "domain")
    budget = 2 * int(rows.agg(F.sum("cost").alias("s")).first()["s"])
    return X.schedule_report(X.exposure_schedule(rows, budget, 10, 4), budget, by="domain").select("domain", "tokens", "occurrences", "unique_records")


@query(
    "sel_concentration",
    """with c as (select p_partkey, count(l_partkey) as n from part left join lineitem on l_partkey = p_partkey group by 1),
       p as (select n * 1.0 / sum(n) over () as p, 1.0 / count(*) over () as u, n from c)
       select round(1 / sum(p * p), 6) as ess, round(sum(abs(p - u)) / 2, 6) as tv_from_uniform, round(max(p), 9) as max_probability,
         count(case when n > 0 then 1 end) as unique_exposed from p""",
)
def sel_concentration(spark, sf):
    parts = T.table(spark, sf, "part").select("p_partkey")
    sold = T.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    counts = parts.join(sold, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    out = X.concentration(counts, "n")
    return out.select(r("ess").alias("ess"), r("tv_from_uniform").alias("tv_from_uniform"), r("max_probability", 9).alias("max_probability"), "unique_exposed")


@query("sel_budgeted_query_select")
def sel_budgeted_query_select(spark, sf):
    from workload.vectors import _nuisance

    rows = T.wide(spark, sf)
    weights, _ = X.budgeted_query_select(
        _nuisance(spark, sf).select("id", "v", "z"), rows.select("id", "a"), 12, "residual_frontier", T.D, 5, 3, floor=0.1, seed=2
    )
    return weights


@query("sel_active_query_select")
def sel_active_query_select(spark, sf):
    rows = T.wide(spark, sf)
    trace, _ = X.active_query_select(rows.select("id", "v"), rows.select("id", "a"), "v", T.D, 8, 3, seed=2)
    return trace


@query(
    "sel_query_ledger",
    """with asked as (select l_partkey as id, count(*) as n from lineitem where l_shipdate < timestamp '1996-01-01' group by 1),
       paid as (select distinct l_suppkey as id from lineitem),
       s as (select asked.id, case when n > 1 then 'duplicate' when p_partkey is null then 'unknown' when paid.id is not null then 'charged_before' else 'new' end as status
             from asked left join part on p_partkey = asked.id left join paid on paid.id = asked.id)
       select * from s""",
)
def sel_query_ledger(spark, sf):
    lines = T.table(spark, sf, "lineitem")
    requests = lines.filter("l_shipdate < timestamp '1996-01-01'").select(F.col("l_partkey").alias("id"))
    ledger = lines.select(F.col("l_suppkey").alias("id"))
    pool_ids = T.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return X.query_ledger(requests, ledger, pool_ids, 10_000_000)


@query(
    "sel_charged_queries",
    """with a as (select id, 'random_frontier-2' as request from vec order by sha256('2|' || id) limit 24),
       b as (select id, 'random_frontier-5' as request from vec order by sha256('5|' || id) limit 24),
       c as (select id, min(request) as request from (select * from a union all select * from b) group by id)
       select *, (select count(*) from c) as charged from c""",
    "vec",
)
def sel_charged_queries(spark, sf):
    """Two selections pay for their responses from one ledger, the first one twice, which charges nothing anew."""
    import uuid

    from winnow.operators.ledger import ResponseLedger
    from winnow.plans.cut import checkpoint_folder

    rows = T.wide(spark, sf)
    ledger = ResponseLedger(spark, f"{checkpoint_folder(spark)}/winnow/{uuid.uuid4().hex}", 48)
    paid = []
    for seed in (2, 2, 5):
        _, report = X.budgeted_query_select(rows.select("id", "v"), rows.select("id", "a"), 24, "random_frontier", T.D, 5, 3, seed=seed, ledger=ledger)
        paid.append(report["charged"])
    if paid[0] != paid[1]:
        raise AssertionError(f"a repeated selection was charged: {paid}")
    return ledger.charged().withColumn("charged", F.lit(paid[-1]).cast("bigint"))


@query(
    "smp_seeded_order",
    "select id, sha256('17|' || id) as h from vec",
    "vec",
)
def smp_seeded_order(spark, sf):
    """The digest every seeded draw orders by."""
    return T.vec(spark, sf).select("id", seeded(17, "id").alias("h"))


def _composed(spark, sf):
    """Training records of the conversations, each with the vector its conversation is dealt."""
    records = T.sft(spark, sf).filter("split = 'train'")
    vectors = T.vec(spark, sf).select("id", "v")
    n = vectors.count()
    dealt = records.withColumn("_at", F.col("root_id").cast("bigint") % n)
    return dealt.join(vectors.withColumnRenamed("id", "_at"), "_at").drop("_at").withColumn("z", F.array(F.lit(1.0), F.log1p("cost")))


@query(
    "sel_composed_pipeline",
    """with t as (select * from sft where split = 'train'), n as (select count(distinct root_id) as n from t),
         roots as (select root_id from (select root_id, row_number() over (order by sha256('42|' || root_id)) as k from (select distinct root_id from t))
                   where k <= (select n // 2 from n)),
         p as (select * from t where root_id in (select root_id from roots)), b as (select cast(floor(sum(cost) * 0.5) as bigint) as budget from p)
       select count(*) as pool_rows, count(distinct root_id) as roots, cast(sum(cost) as bigint) as pool_tokens, (select budget from b) as budget,
         cast(0 as bigint) as violations from p""",
    "sft",
)
def sel_composed_pipeline(spark, sf):
    """All steps in a row over half of all roots, however many there are; what must hold of selection, refill and plan is counted as violations.

    Which rows are selected, refilled and planned is held against plain versions in tests/test_compose.py.
    """
    from winnow.operators.compose import compose
    from winnow.operators.sampling import root_reservoir

    records = cut(_composed(spark, sf))
    roots = records.select("root_id").distinct().count() // 2
    budget = int(root_reservoir(records, "root_id", roots, 42).agg(F.sum("cost").alias("s")).first()["s"] * 0.5)
    config = S.SelectConfig(budget=budget, keep_all_when_fits=False, provenance_cap=3)
    out = compose(records, "v", "z", F.col("domain") == "opening", T.D, 2, roots, config, 2 * budget)
    pool = out.pool.agg(F.count("*").alias("pool_rows"), F.countDistinct("root_id").alias("roots"), F.sum("cost").alias("pool_tokens"))
    spent = out.selected.agg(F.sum("cost")).first()[0]
    planned = out.plan.agg(F.sum("response_tokens")).first()[0]
    cells = out.pool.select("id", "cell")
    moved = out.swaps.join(cells.withColumnsRenamed({"id": "id_in", "cell": "a"}), "id_in").join(cells.withColumnsRenamed({"id": "id_out", "cell": "b"}), "id_out")
    odd = moved.filter("a <> b or token_delta <> 0 or gain <= 0").count()
    crowded = out.selected.groupBy("grp").count().filter("count > 3").count()
    bad = odd + crowded + int(not 0 < spent <= budget) + int(not 0 < planned <= 2 * budget) + out.audit.count()
    return pool.select("pool_rows", "roots", "pool_tokens", F.lit(budget).cast("bigint").alias("budget"), F.lit(bad).cast("bigint").alias("violations"))
