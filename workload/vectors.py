"""Vectors, sketches, sparse codes, dictionaries and units."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from winnow.functions.keys import seeded
from winnow.functions.vectors import dot, unit
from winnow.operators import codes as C
from winnow.operators import vectors as V
from workload import tables as T
from workload.registry import query, r


@query(
    "vec_unit",
    """with n as (select id, sqrt(sum(x * x)) as n from vec_long group by id)
       select id, pos, round(x / n, 6) as x from vec_long join n using (id)""",
    "vec_long",
)
def vec_unit(spark, sf):
    rows = T.vec(spark, sf).select("id", F.posexplode(unit("v")).alias("pos", "x"))
    return rows.select("id", F.col("pos").cast("bigint").alias("pos"), r("x").alias("x"))


@query(
    "vec_count_sketch",
    """with w as (select doc_id, unnest(string_split(text, ' ')) as token from documents),
       h as (select token, cast('0x' || substr(sha256('7|' || token), 1, 12) as bigint) as h from (select distinct token from w))
       select doc_id, cast((h // 2) % 64 as integer) as bucket, cast(sum(case when h % 2 = 0 then 1.0 else -1.0 end) as double) as s
       from w join h using (token) group by all""",
)
def vec_count_sketch(spark, sf):
    """Token counts of whole documents, hashed to 64 signed buckets."""
    words = T.spread(T.table(spark, sf, "documents")).select("doc_id", F.explode(F.split("text", " ")).alias("token"), F.lit(1.0).alias("n"))
    return V.count_sketch(words, "doc_id", "token", "n", 64, 7)


@query("vec_random_projection")
def vec_random_projection(spark, sf):
    rows = V.random_projection(T.vec(spark, sf), "v", T.D, 16, 3)
    return rows.select("id", F.posexplode("projected").alias("pos", "x"))


def _nuisance(spark, sf):
    """A constant, the cost and the first three labels as nuisance."""
    flags = [F.when(F.col("label") == k, 1.0).otherwise(0.0) for k in range(3)]
    return T.vec(spark, sf).withColumn("z", F.array(F.lit(1.0), F.col("cost").cast("double"), *flags)).withColumn("w", F.col("cost").cast("double"))


@query("vec_nuisance_residual")
def vec_nuisance_residual(spark, sf):
    """The weighted residual is orthogonal to the nuisance: the sums reported must vanish."""
    rows, _ = C.nuisance_residual(_nuisance(spark, sf), "v", "z", T.D, 5, "w")
    long = rows.select("w", F.explode("z").alias("z"), "residual").select((F.col("w") * F.col("z")).alias("wz"), F.posexplode("residual").alias("pos", "x"))
    return long.groupBy("pos").agg(F.round(F.abs(F.sum(F.col("wz") * F.col("x"))), 6).alias("inner"))


@query("vec_crossfit_residual")
def vec_crossfit_residual(spark, sf):
    rows = _nuisance(spark, sf).withColumn("fold", (F.col("id") % 4).cast("int"))
    out = C.crossfit_residual(rows, "v", "z", "fold", 4, T.D, 5)
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.avg(dot("residual", "residual")).alias("mean_square"))


@query(
    "vec_history_sensitive",
    """with c as (select id - 1 as id, pos, x from vec_long where id >= 1 union all select id - 2, pos, x from vec_long where id >= 2),
       m as (select id, pos, avg(x) as m from c group by all)
       select v.id, v.pos, round(v.x - m.m, 6) as x from vec_long v join m using (id, pos)""",
    "vec_long",
)
def vec_history_sensitive(spark, sf):
    """The two following vectors are each row's controls."""
    full = T.vec(spark, sf).select("id", "v")
    controls = full.withColumn("id", F.explode(F.array(F.col("id") - 1, F.col("id") - 2))).filter("id >= 0")
    out = V.history_sensitive(full, controls, "id", "v").select("id", F.posexplode("v").alias("pos", "x"))
    return out.select("id", F.col("pos").cast("bigint").alias("pos"), r("x").alias("x"))


def _bank(spark, sf, k: int = 8):
    return C.fit_atom_bank(_nuisance(spark, sf), "id", "v", "z", T.D, 5, k, 2, 3, 1)


@query("vec_sparse_code")
def vec_sparse_code(spark, sf):
    d = C.random_dictionary(32, T.D, 4)
    rows = C.sparse_code(T.vec(spark, sf), "v", d, 4, pooled=True)
    return rows.select("id", F.explode("code").alias("c")).select("id", "c.atom", "c.w")


@query("vec_fit_dictionary")
def vec_fit_dictionary(spark, sf):
    fit = C.fit_dictionary(T.vec(spark, sf), "id", "v", T.D, 8, 2, 3, 1)
    return spark.createDataFrame(
        [(k, float(np.linalg.norm(a)), float(fit.mse)) for k, a in enumerate(fit.atoms)], "atom int, norm double, mse double"
    )


@query("vec_atom_bank")
def vec_atom_bank(spark, sf):
    """Fit on all rows, freeze, and encode them again through the saved bank."""
    import uuid

    from winnow.plans.cut import checkpoint_folder

    path = f"{checkpoint_folder(spark)}/winnow/{uuid.uuid4().hex}"
    _bank(spark, sf).save(spark, path)
    bank = C.AtomBank.load(spark, path)
    coded = bank.transform(_nuisance(spark, sf), "v", "z")
    return coded.select("id", F.explode("code").alias("c")).select("id", "c.atom", "c.w")


@query("str_encode")
def str_encode(spark, sf):
    """The frozen bank on a stream of vectors."""
    from winnow.streaming import ops as O
    from workload.streams import _folders, _stream

    bank = _bank(spark, sf, 4)
    out, state = _folders(spark)
    flags = [F.when(F.col("label") == k, 1.0).otherwise(0.0) for k in range(3)]
    stream = _stream(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"),
        F.array(F.lit(1.0), (F.col("vec_id") % 7 + 1).cast("double"), *flags).alias("z"),
    )
    O.run_available(bank.transform(stream, "v", "z").select("id", "code"), out, state)
    return spark.read.parquet(out).select("id", F.explode("code").alias("c")).select("id", "c.atom", "c.w")


@query("vec_gram_coordinates")
def vec_gram_coordinates(spark, sf):
    """Largest difference between the norm of the coordinates and of the decoded vector: zero."""
    d = C.random_dictionary(16, T.D, 4)
    rows = C.reconstruct(C.gram_coordinates(C.sparse_code(T.vec(spark, sf), "v", d, 3), "code", d), "code", d)
    gap = F.abs(dot("z", "z") - dot("decoded", "decoded"))
    return rows.agg(F.count("*").alias("rows"), F.round(F.max(gap), 9).alias("largest_gap"))


@query(
    "vec_alignment",
    """with c as (select pos, avg(x) as m from vec_long where label = 3 group by pos), cn as (select sqrt(sum(m * m)) as n from c),
       d as (select v.id, sum(v.x * c.m) as dot, sqrt(sum(v.x * v.x)) as n from vec_long v join c using (pos) group by v.id)
       select id, round(dot / (d.n * cn.n), 6) as score from d, cn""",
    "vec_long",
)
def vec_alignment(spark, sf):
    rows = T.vec(spark, sf)
    return V.alignment(rows, "v", rows.filter("label = 3"), "v").select("id", r("score").alias("score"))


@query("vec_geometry_diagnostics")
def vec_geometry_diagnostics(spark, sf):
    d = C.random_dictionary(16, T.D, 4)
    return C.geometry_diagnostics(C.sparse_code(T.vec(spark, sf), "v", d, 3, pooled=True), "v", "code", d, T.D)


def _farthest_sql(k: int, seed: int) -> str:
    """One step after another: the row farthest from those taken, by the distance to the nearest of them."""
    steps = [f"c0 as (select arg_min(id, sha256('{seed}|' || id)) as id from vec)", "d0 as (select id, cast('infinity' as double) as d from vec)"]
    for n in range(1, k):
        far = "list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - y.v[i]) * (x.v[i] - y.v[i])))"
        taken = " union all ".join(f"select id from c{i}" for i in range(n))
        steps += [
            f"d{n} as materialized (select x.id, least(d.d, {far}) as d from vec x join d{n - 1} d using (id), (select v from vec where id = (select id from c{n - 1})) y)",
            f"c{n} as materialized (select id from d{n} where id not in ({taken}) order by round(d, 12) desc, id limit 1)"]
    return f"with {', '.join(steps)} " + " union all ".join(f"select id, {n} as step from c{n}" for n in range(k))


@query("vec_farthest_first", _farthest_sql(10, 5), "vec")
def vec_farthest_first(spark, sf):
    ids = V.farthest_first(T.vec(spark, sf), "id", "v", 10, 5)
    return spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id bigint, step int")


@query("vec_clusters")
def vec_clusters(spark, sf):
    """Groups below the floor are dropped; every kept group is a distribution."""
    rows = T.vec(spark, sf)
    member, _ = V.vector_clusters(rows, "id", "v", 10, 3, floor=20)
    return member.groupBy("unit").agg(F.count("*").alias("records"), F.round(F.sum("p"), 9).alias("mass"))


def _threshold_codes(spark, sf):
    """Components of at least 0.15 in size as sparse codes."""
    long = T.vec(spark, sf).select("id", F.filter(
        F.transform("v", lambda x, i: F.struct(i.alias("atom"), x.alias("w"))), lambda c: F.abs(c["w"]) >= 0.15
    ).alias("code"))
    return long


_CODES = "codes as (select id, pos as atom, x as w, case when x > 0 then 1 else -1 end as sign, abs(x) as mass from vec_long where abs(x) >= 0.15)"
_UNITS = f"""{_CODES}, u as (select atom, sign, sum(mass) as s, sum(mass * mass) as ss, count(*) as support from codes group by all
     having count(*) >= 8 and sum(mass) * sum(mass) / sum(mass * mass) >= 6)"""


@query(
    "vec_signed_units",
    f"""with {_UNITS} select 'atom_' || atom || case when sign > 0 then '_positive' else '_negative' end as unit, support, round(s * s / ss, 6) as ess from u""",
    "vec_long",
)
def vec_signed_units(spark, sf):
    _, units = V.signed_units(_threshold_codes(spark, sf), "id", "code")
    return units.select("unit", F.col("support").cast("bigint").alias("support"), r("ess").alias("ess"))


@query(
    "vec_signed_unit_membership",
    f"""with {_UNITS} select id as record_id, 'atom_' || atom || case when sign > 0 then '_positive' else '_negative' end as unit, round(mass / s, 9) as p
        from codes join u using (atom, sign)""",
    "vec_long",
)
def vec_signed_unit_membership(spark, sf):
    member, _ = V.signed_units(_threshold_codes(spark, sf), "id", "code")
    return member.select("record_id", "unit", r("p", 9).alias("p"))


@query(
    "vec_categorical_units",
    "select id as record_id, cast(label as varchar) as unit, round(1.0 / count(*) over (partition by label), 9) as p from vec",
    "vec",
)
def vec_categorical_units(spark, sf):
    return V.categorical_units(T.vec(spark, sf), "id", "label").select("record_id", "unit", r("p", 9).alias("p"))


@query("vec_random_units")
def vec_random_units(spark, sf):
    """The control: units of a random dictionary."""
    rows = C.sparse_code(T.vec(spark, sf), "v", C.random_dictionary(12, T.D, 8), 3)
    _, units = V.signed_units(rows, "id", "code")
    return units


@query(
    "vec_nominate_rows",
    f"""with {_CODES}, best as (select arg_max(id, (value, -id)) as id from resp group by objective),
        top as (select id from codes qualify row_number() over (partition by atom order by round(abs(w), 12) desc, id) <= 2)
        select id from best union select id from top""",
    "vec_long resp",
)
def vec_nominate_rows(spark, sf):
    rows = T.wide(spark, sf).select("id", "a").join(_threshold_codes(spark, sf), "id")
    return V.nominate_rows(rows, "id", "code", "a", 3, 2)


@query(
    "vec_cover_radius",
    """with s as (select * from wide order by sha256('6|' || id) limit 16),
       d as (select w.id, min(greatest(abs(w.a0 - s.a0), abs(w.a1 - s.a1), abs(w.a2 - s.a2))) as d from wide w, s group by w.id)
       select round(max(d), 6) as radius from d""",
    "wide",
)
def vec_cover_radius(spark, sf):
    rows = T.wide(spark, sf).select("id", "a")
    queried = [x["a"] for x in rows.orderBy(seeded(6, "id")).limit(16).collect()]
    return V.cover_radius(rows, "a", queried).select(r("radius").alias("radius"))
