"""Responses, frontier weights and mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions.keys import seeded
from winnow.functions.vectors import mean_by
from winnow.operators import frontier as P
from winnow.operators import mixtures as X
from winnow.operators.sampling import stratified_sample
from winnow.operators.vectors import categorical_units
from winnow.plans.cut import cut
from workload import tables as T
from workload.registry import query, r

A3 = [f"round(a{i}, 6) as a{i}" for i in range(3)]


def _three(df, digits: int = 6):
    return df.select("id", *[r(F.col("a")[i], digits).alias(f"a{i}") for i in range(3)])


@query("fro_response_matrix", f"select id, {', '.join(A3)} from wide", "wide")
def fro_response_matrix(spark, sf):
    return _three(T.wide(spark, sf))


@query(
    "fro_response_with_floor",
    """with m as (select avg(a0) as m0, avg(a1) as m1, avg(a2) as m2 from wide)
       select id, round(0.2 * m0 + 0.8 * a0, 6) as a0, round(0.2 * m1 + 0.8 * a1, 6) as a1, round(0.2 * m2 + 0.8 * a2, 6) as a2 from wide, m""",
    "wide",
)
def fro_response_with_floor(spark, sf):
    rows = _with_p(T.wide(spark, sf))
    return _three(P.response_with_floor(rows, "a", "p", 0.2, 3))


def _with_p(df):
    n = df.agg(F.count("*").alias("n")).select("n").scalar()
    return df.withColumn("p", F.lit(1.0) / n)


def _with_cost_p(df, out="q"):
    total = df.agg(F.sum("cost").alias("t")).select("t").scalar()
    return df.withColumn(out, F.col("cost") / total)


@query("fro_frontier_weights")
def fro_frontier_weights(spark, sf):
    solved = P.frontier_weights(T.wide(spark, sf), "id", "a", 3)
    return solved.frame(spark).withColumn("margin", F.lit(solved.margin)).withColumn("gap", F.lit(solved.gap))


@query(
    "fro_frontier_certificate",
    """with q as (select *, cost * 1.0 / sum(cost) over () as q from wide join vec using (id)),
       s as (select least(sum(q * a0), sum(q * a1), sum(q * a2)) as low, max(0.5 * a0 + 0.3 * a1 + 0.2 * a2) as up from q)
       select round(low, 6) as low, round(up, 6) as up, round(up - low, 6) as gap, (up - low >= -1e-7 and up - low <= 1e-7 * (1 + abs(up))) as certified from s""",
    "wide vec",
)
def fro_frontier_certificate(spark, sf):
    out = P.frontier_certificate(_with_cost_p(T.wide(spark, sf)), "a", "q", [0.5, 0.3, 0.2], 3)
    return out.select(r("low").alias("low"), r("up").alias("up"), r("gap").alias("gap"), "certified")


@query(
    "fro_price_columns",
    """select id, round(0.5 * a0 + 0.3 * a1 + 0.2 * a2 - 0.01, 6) as reduced from wide
       order by round(0.5 * a0 + 0.3 * a1 + 0.2 * a2 - 0.01, 12) desc, id limit 20""",
    "wide",
)
def fro_price_columns(spark, sf):
    return P.price_columns(T.wide(spark, sf), "id", "a", [0.5, 0.3, 0.2], 0.01, 20).select("id", r("reduced").alias("reduced"))


@query("fro_dual_face_gain")
def fro_dual_face_gain(spark, sf):
    """What the vectors of labels 0 to 2 add to the margin of the others."""
    rows = T.wide(spark, sf)
    out = P.dual_face_gain(rows.filter("label >= 3"), rows.filter("label < 3"), "id", "a", 3)
    return spark.createDataFrame([(out["old_margin"], out["gain"], out["positive"])], "old_margin double, gain double, positive boolean")


@query("fro_robust_frontier")
def fro_robust_frontier(spark, sf):
    rows = T.wide(spark, sf).withColumn("u", F.transform("a", lambda x: F.abs(x) * 0.1))
    solved = P.robust_frontier(rows, "id", "a", "u", 3)
    return solved.frame(spark).withColumn("margin", F.lit(solved.margin))


@query(
    "fro_response_interval",
    """with n as (select id, any_value(label) as label, sqrt(sum(x * x)) as n from vec_long group by id),
       c as (select l.label, l.pos, avg(l.x * case when n.n > 0.9 then 0.9 / n.n else 1.0 end) as m from vec_long l join n using (id) where l.label < 3 group by all),
       k as (select label, count(*) as k from n where label < 3 group by label), t as (select count(*) as t from n),
       d as (select v.id, c.label as objective, sum(v.x * c.m) as mean from vec_long v join c using (pos) group by all)
       select d.id, d.objective, round(mean, 6) as mean, round(0.9 * n.n * sqrt(2 * ln(2.0 * 3 * t / 0.05) / k), 6) as radius
       from d join n using (id) join k on k.label = d.objective, t""",
    "vec_long",
)
def fro_response_interval(spark, sf):
    rows = T.vec(spark, sf)
    out = P.response_interval(rows.filter("label < 3"), "label", "v", rows, "id", "v", 0.9)
    return out.select("id", "objective", r("mean").alias("mean"), r("radius").alias("radius"))


@query("fro_capped_frontier")
def fro_capped_frontier(spark, sf):
    q, info = P.capped_frontier(T.wide(spark, sf), "id", "a", 3, 8.0, 0.1)
    return q.withColumn("margin", F.lit(info["margin"])).withColumn("gap", F.lit(info["gap"]))


@query("fro_guarded_weights")
def fro_guarded_weights(spark, sf):
    """The first response is maximized while the other two stay at or above zero."""
    q, info = P.guarded_weights(T.wide(spark, sf), "id", "a", 3, [1.0, 0.0, 0.0], {1: 0.0, 2: 0.0}, 8.0, 0.1)
    return q.withColumn("primary", F.lit(info["primary"]))


_UNITS = """u as (select id // 5 as id, avg(a0) as a0, avg(a1) as a1, avg(a2) as a2, count(*) as n from wide group by 1)"""


def _units(spark, sf):
    """Groups of five vectors as units."""
    rows = T.wide(spark, sf).withColumn("unit", F.floor(F.col("id") / 5))
    return mean_by(rows, ["unit"], "a", out="a").select(F.col("unit").alias("id"), "a")


@query(
    "fro_best_pair",
    f"""with {_UNITS}, p as (select l.id as "left", r.id as "right", l.a0 as l0, l.a1 as l1, l.a2 as l2, r.a0 - l.a0 as s0, r.a1 - l.a1 as s1, r.a2 - l.a2 as s2,
          least(l.a0, l.a1, l.a2) as lm, least(r.a0, r.a1, r.a2) as rm from u l join u r on l.id < r.id),
        f as (select *, unnest([0.0, 1.0, case when abs(s0 - s1) > 1e-14 then (l1 - l0) / (s0 - s1) end,
          case when abs(s0 - s2) > 1e-14 then (l2 - l0) / (s0 - s2) end, case when abs(s1 - s2) > 1e-14 then (l2 - l1) / (s1 - s2) end]) as f from p),
        v as (select *, least(l0 + f * s0, l1 + f * s1, l2 + f * s2) as m from f where f between 0 and 1),
        b as (select "left", "right", any_value(lm) as lm, any_value(rm) as rm, max(m) as margin from v group by all),
        k as (select *, margin - greatest(0, lm, rm) as gain, (lm <= 1e-9 and rm <= 1e-9 and margin > 1e-9) as strict from b)
        select "left", "right", round(margin, 6) as margin, round(gain, 6) as gain, strict from k
        order by strict desc, round(gain, 12) desc, round(margin, 12) desc, "left", "right" limit 1""",
    "wide",
)
def fro_best_pair(spark, sf):
    out = P.best_pair(_units(spark, sf), "id", "a", 3)
    return out.select("left", "right", r("margin").alias("margin"), r("gain").alias("gain"), "strict")


@query("fro_opportunity")
def fro_opportunity(spark, sf):
    out = P.opportunity(T.wide(spark, sf), "id", "a", 3)
    return spark.createDataFrame(
        [(out["single_margin"], out["mixed_margin"], out["gap"], out["no_update_mass"])],
        "single_margin double, mixed_margin double, gap double, no_update_mass double",
    )


def _labels(spark, sf):
    """Label units with weight proportional to label + 1 and norm label / 10: label 0 has norm zero."""
    units = T.vec(spark, sf).select("label").distinct()
    return units.select(F.col("label").cast("string").alias("unit"), ((F.col("label") + 1) / 55.0).alias("w"), (F.col("label") / 10.0).alias("norm"))


@query(
    "fro_executable_distribution",
    """with m as (select id, label, 1.0 / count(*) over (partition by label) as p from vec),
       raw as (select id, p * case when label = 0 then 0 else ((label + 1) / 55.0) / (label / 10.0) end as p from m)
       select id as record_id, round(p / sum(p) over (), 9) as p, round(sum(p) over (), 6) as scale from raw""",
    "vec",
)
def fro_executable_distribution(spark, sf):
    member = categorical_units(T.vec(spark, sf), "id", "label")
    units = _labels(spark, sf)
    out = X.executable_distribution(member, units.select("unit", "norm"), units.select("unit", "w"))
    return out.select("record_id", r("p", 9).alias("p"), r("scale").alias("scale"))


@query(
    "fro_mix",
    "select id as record_id, round((label + 1) / 55.0 / count(*) over (partition by label), 9) as p from vec",
    "vec",
)
def fro_mix(spark, sf):
    member = categorical_units(T.vec(spark, sf), "id", "label")
    return X.mix(member, _labels(spark, sf).select("unit", "w")).select("record_id", r("p", 9).alias("p"))


@query(
    "fro_scalar_weights",
    """with m as (select id, (a0 + a1 + a2) / 3 as m from wide), s as (select stddev_pop(m) + 1e-12 as sd, max(m) as t from m),
       e as (select id, exp((m - t) / sd) as e from m, s) select id, round(e / sum(e) over (), 9) as q from e""",
    "wide",
)
def fro_scalar_weights(spark, sf):
    return X.scalar_weights(T.wide(spark, sf), "a").select("id", r("q", 9).alias("q"))


@query(
    "fro_descent_bound",
    """with d as (select pos, avg(x) as d from vec_long group by pos), dn as (select sqrt(sum(d * d)) as n from d),
       s as (select sum(x * x) / (select count(distinct id) from vec_long) as sq from vec_long),
       t as (select label as objective, sum(g * d) as gd, sqrt(sum(g * g)) as gn from target join d using (pos) group by label)
       select objective, round(0.1 * (gd - 0.01 * n - (gn + 0.01) * 0.02) - 0.5 * 2 * 0.01 * pow(n + 0.02, 2) - 0.5 * 2 * 0.01 * greatest(sq - n * n, 0) / 64, 6) as bound
       from t, dn, s""",
    "vec_long target",
)
def fro_descent_bound(spark, sf):
    rows = _with_p(T.vec(spark, sf))
    out = P.descent_bound(rows, "v", "p", T.targets(spark, sf), 0.1, 2.0, 0.01, 0.02, 64)
    return out.select("objective", r("bound").alias("bound"))


@query("fro_cap_distribution")
def fro_cap_distribution(spark, sf):
    """A steep candidate clipped to a quarter and four times the base, per label; masses must agree."""
    rows = _with_p(T.vec(spark, sf)).withColumn("c", F.pow(F.lit(0.5), F.col("id") % 23))
    out = X.cap_distribution(rows, "c", "p", "cell", out="capped")
    return out.groupBy("cell").agg(
        F.count("*").alias("n"), F.round(F.sum("p"), 9).alias("base_mass"), F.round(F.sum("capped"), 9).alias("capped_mass"),
        F.max(F.col("capped") / F.col("p")).alias("largest_ratio"), F.min(F.col("capped") / F.col("p")).alias("smallest_ratio"),
    )


@query(
    "fro_bounded_proposal",
    """with q as (select id, 1.0 / count(*) over () as b, cost * 1.0 / sum(cost) over () as q from vec), x as (select max(q / b) as r from q)
       select id, round((1 - t) * b + t * q, 9) as p from (select *, least(0.9, 0.75, case when r > 1 + 1e-12 then (1.5 - 1) / (r - 1) else 1 end) as t from q, x)""",
    "vec",
)
def fro_bounded_proposal(spark, sf):
    rows = _with_cost_p(_with_p(T.vec(spark, sf)))
    return X.bounded_proposal(rows, "p", "q", 0.9, 1.5, 0.25, "mixed").select("id", r("mixed", 9).alias("p"))


@query(
    "fro_domain_mass_proposals",
    """with d as (select id, label < 5 as one, 0.5 / count(*) over (partition by label < 5) as b from vec)
       select id, 'domain_mass_' || m as proposal, round(b * 2 * case when one then m else 1 - m end, 9) as p
       from d, (select unnest([0.25, 0.375, 0.625, 0.75]::double[]) as m)""",
    "vec",
)
def fro_domain_mass_proposals(spark, sf):
    from winnow.operators.sampling import base_distribution

    rows = T.vec(spark, sf).withColumn("domain", F.when(F.col("label") < 5, "one").otherwise("two"))
    base = base_distribution(rows, "domain", "equal_domains")
    out = X.domain_mass_proposals(base.withColumnRenamed("p", "base"), "base", "domain", "one", [0.25, 0.375, 0.625, 0.75])
    return out.select("id", "proposal", r("p", 9).alias("p"))


@query(
    "fro_ht_response",
    """with q as (select id, label, cost * 1.0 / sum(cost) over () as q, 1.0 / count(*) over () as p from vec),
       s as (select * from q qualify row_number() over (partition by label order by sha256('12|' || id)) <= 8),
       w as (select id, q / p / (select count(*) from s) as w from s),
       d as (select pos, sum(w * x) as d from vec_long join w using (id) group by pos)
       select label as objective, round(sum(g * d), 6) as response from target join d using (pos) group by label""",
    "vec vec_long target",
)
def fro_ht_response(spark, sf):
    rows = _with_cost_p(_with_p(T.vec(spark, sf)))
    sample = stratified_sample(rows, ["label"], "id", 8, 12)
    return X.ht_response(sample, "v", "q", "p", T.targets(spark, sf)).select("objective", r("response").alias("response"))


@query(
    "fro_proposal_menu",
    """with l as (select label, avg(a0) as a0, avg(a1) as a1, avg(a2) as a2 from wide join vec using (id) group by label),
       s as (select label as "left", label as "right", 0.0 as f, round(least(a0, a1, a2), 12) as score from l),
       t as (select * from l order by round(least(a0, a1, a2), 12) desc, label desc limit 4),
       m as (select x.label as "left", y.label as "right", f, round(least((1 - f) * x.a0 + f * y.a0, (1 - f) * x.a1 + f * y.a1, (1 - f) * x.a2 + f * y.a2), 12) as score
             from t x join t y on x.label < y.label, (select unnest([0.25, 0.5, 0.75]) as f))
       select "left", "right", cast(f as double) as fraction, round(score, 6) as score from (select * from s union all select * from m)
       order by score desc, "left", "right", f limit 1""",
    "wide vec",
)
def fro_proposal_menu(spark, sf):
    units = mean_by(T.wide(spark, sf), ["label"], "a", out="a")
    return X.proposal_menu(units, "label", "a", 3).select("left", "right", "fraction", r("score").alias("score"))


@query(
    "fro_matched_random",
    """with q as (select id, label, cost * 1.0 / sum(cost) over () as q from vec)
       select id, round(sum(q) over (partition by label) / count(*) over (partition by label), 9) as matched from q""",
    "vec",
)
def fro_matched_random(spark, sf):
    return X.matched_random(_with_cost_p(T.vec(spark, sf)), "q", "label").select("id", r("matched", 9).alias("matched"))


@query("fro_bootstrap_gap")
def fro_bootstrap_gap(spark, sf):
    """Labels below and from five as two tasks, the three responses as units."""
    rows = T.wide(spark, sf).select(F.col("id").alias("record_id"), F.col("a").alias("gains"), "label")
    out = X.bootstrap_gap(rows.filter("label < 5"), rows.filter("label >= 5"), [0.4, 0.3, 0.3], 1000)
    return spark.createDataFrame([(out["gap"], out["low"], out["high"])], "gap double, low double, high double")


@query("fro_seeded_sample", "select id from wide order by sha256('6|' || id) limit 16", "wide")
def fro_seeded_sample(spark, sf):
    """Rows whose responses are fetched first."""
    return T.wide(spark, sf).orderBy(seeded(6, "id")).limit(16).select("id")


@query(
    "fro_warm_start",
    """select cast(3 as bigint) as solved, true as same_margin, true as fewer_rounds, true as certified,
         (select count(*) from vec where label < 8) as old_rows, (select count(*) from vec) as new_rows""",
    "vec",
)
def fro_warm_start(spark, sf):
    """The frontier of a table that has grown, from its stored old columns and from nominated rows, against a cold start."""
    import uuid

    from winnow.operators.vectors import farthest_first
    from winnow.plans.cut import checkpoint_folder

    rows = cut(T.wide(spark, sf))
    before = P.frontier_weights(rows.filter("label < 8"), "id", "a", 3)
    path = f"{checkpoint_folder(spark)}/winnow/{uuid.uuid4().hex}"
    before.pool(spark).write.parquet(path)
    cold = P.frontier_weights(rows, "id", "a", 3)
    warm = P.frontier_weights(rows, "id", "a", 3, start=spark.read.schema("id bigint, a array<double>").parquet(path))
    nominated = spark.createDataFrame([(i,) for i in farthest_first(rows.select("id", "v"), "id", "v", 8, 1)], "id bigint")
    spread = P.frontier_weights(rows, "id", "a", 3, start=nominated)
    same = max(abs(x.margin - cold.margin) for x in (warm, spread)) <= 1e-6 * (1 + abs(cold.margin))
    counts = rows.agg(F.sum(F.when(F.col("label") < 8, 1).otherwise(0)).alias("old_rows"), F.count("*").alias("new_rows"))
    return counts.select(
        F.lit(3).cast("bigint").alias("solved"), F.lit(bool(same)).alias("same_margin"), F.lit(bool(warm.rounds <= cold.rounds)).alias("fewer_rounds"),
        F.lit(bool(warm.certified and spread.certified)).alias("certified"), "old_rows", "new_rows")
