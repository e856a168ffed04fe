"""Histories, tasks, splits, prompts and item codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions.keys import stable_bucket
from winnow.operators import catalog as K
from winnow.operators import history as H
from workload import tables as T
from workload.registry import query, r


@query(
    "hist_strict_history",
    """select event_id, coalesce(array_to_string(list_transform(history, lambda x: x.i), ','), '') as history,
         len(history) as n from hist""",
    "hist",
)
def hist_strict_history(spark, sf):
    rows = T.hist(spark, sf)
    return rows.select(
        "event_id", F.array_join(T.items(), ",").alias("history"), F.size("history").cast("bigint").alias("n")
    )


@query(
    "hist_strict_history_events",
    """select event_id, coalesce(array_to_string(list_transform(history, lambda x: x.i || '@' || x.t), ','), '') as history from ehist""",
    "ehist",
)
def hist_strict_history_events(spark, sf):
    """Day-truncated times: most events share their instant with others of the same user."""
    seen = F.transform("history", lambda x: F.concat(x["item_id"], F.lit("@"), x["timestamp"].cast("string")))
    return T.ehist(spark, sf).select("event_id", F.array_join(seen, ",").alias("history"))


_TASK_VIEWS = """past as (select h.event_id, list(coalesce(c.answer, u.i) order by u.pos) as past,
         list(c.category order by u.pos) filter (where c.category <> '') as cats
       from hist h, (select event_id, unnest(history).i as i, unnest(range(len(history))) as pos from hist) u
       left join cat c on c.item_id = u.i where u.event_id = h.event_id group by h.event_id)"""


@query(
    "hist_next_item_task",
    f"""with {_TASK_VIEWS}
       select h.event_id || ':next' as record_id, h.user_id,
         case when h."timestamp" < 946684800 then 'train' when h."timestamp" < 978307200 then 'select' else 'test' end as split,
         'History: [' || array_to_string(list_transform(past, lambda x: cast(to_json(x) as varchar)), ', ') || ']' || chr(10) || 'Recommend the next item.' as input_text,
         coalesce(c.answer, h.item_id) as output_text
       from hist h join past using (event_id) left join cat c on c.item_id = h.item_id""",
    "hist cat",
)
def hist_next_item_task(spark, sf):
    rows = H.next_item_task(T.tasks(spark, sf), T.TRAIN_END, T.SELECT_END)
    return rows.select("record_id", "user_id", "split", "input_text", "output_text")


@query(
    "hist_category_task",
    f"""with {_TASK_VIEWS},
       n as (select event_id, cat, count(*) as n from (select event_id, unnest(cats) as cat from past) group by all),
       best as (select event_id, cat from n qualify row_number() over (partition by event_id order by n desc, cat) = 1)
       select h.event_id || ':history_category' as record_id,
         'History: [' || array_to_string(list_transform(past, lambda x: cast(to_json(x) as varchar)), ', ') || ']' || chr(10) || 'Return its most frequent recorded category.' as input_text,
         best.cat as output_text
       from hist h join past using (event_id) join best using (event_id) where h."timestamp" < 946684800""",
    "hist cat",
)
def hist_category_task(spark, sf):
    rows = H.history_category_task(T.tasks(spark, sf), T.TRAIN_END, T.SELECT_END)
    return rows.select("record_id", "input_text", "output_text")


@query(
    "hist_id_to_title_task",
    """with t as (select * from hist where len(history) > 0 and "timestamp" < 946684800),
       seen as (select item_id from t union select unnest(history).i from t)
       select sha256('["catalog","retail","' || item_id || '"]') || ':id_title' as record_id,
         'Describe item ' || coalesce(answer, item_id) as input_text, title as output_text
       from seen join cat using (item_id) where title <> ''""",
    "hist cat",
)
def hist_id_to_title_task(spark, sf):
    rows = H.id_to_title_task(T.hist(spark, sf), T.cat(spark, sf), T.TRAIN_END)
    return rows.select("record_id", "input_text", "output_text")


@query(
    "hist_time_split",
    """select case when "timestamp" < 946684800 then 'train' when "timestamp" < 978307200 then 'select' else 'test' end as split,
         count(*) as n, min("timestamp") as lo, max("timestamp") as hi from buy group by 1""",
    "buy",
)
def hist_time_split(spark, sf):
    rows = T.buy(spark, sf).withColumn("split", H.time_split("timestamp", T.TRAIN_END, T.SELECT_END))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))


@query(
    "hist_leave_last_split",
    """with n as (select *, row_number() over (partition by user_id order by "timestamp" desc, event_id desc) as rn,
                count(*) over (partition by user_id) as c from buy)
       select event_id, user_id, case when rn = 3 then 'train' when rn = 1 then 'test'
         when cast('0x' || substr(sha256(user_id), 1, 12) as bigint) % 2 = 0 then 'selection' else 'calibration' end as split
       from n where c >= 5 and rn <= 3""",
    "buy",
)
def hist_leave_last_split(spark, sf):
    rows = H.leave_last_split(T.buy(spark, sf), "user_id", ["timestamp", "event_id"])
    return rows.select("event_id", "user_id", "split")


@query(
    "hist_stable_bucket",
    """select item_id, cast('0x' || substr(sha256('semantic:' || item_id), 1, 12) as bigint) % 1000 as bucket,
         case when cast('0x' || substr(sha256('semantic:' || item_id), 1, 12) as bigint) % 1000 < 700 then 'train'
              when cast('0x' || substr(sha256('semantic:' || item_id), 1, 12) as bigint) % 1000 < 800 then 'selection'
              when cast('0x' || substr(sha256('semantic:' || item_id), 1, 12) as bigint) % 1000 < 900 then 'calibration'
              else 'test' end as split from cat""",
    "cat",
)
def hist_stable_bucket(spark, sf):
    key = F.concat(F.lit("semantic:"), "item_id")
    return T.cat(spark, sf).select("item_id", stable_bucket(key, 1000).alias("bucket"), H.hash_split(key).alias("split"))


@query(
    "hist_one_query_per_user",
    """with q as (select user_id, arg_min(event_id, sha256('7|' || user_id || '|' || event_id)) as event_id from buy group by user_id),
       o as (select *, row_number() over (order by sha256('7|' || user_id)) as rn from q)
       select user_id, event_id, case when rn <= 128 then 'tuning' when rn <= 384 then 'reference' else 'audit' end as part
       from o where rn <= 640""",
    "buy",
)
def hist_one_query_per_user(spark, sf):
    rows = H.one_query_per_user(
        T.buy(spark, sf), "user_id", "event_id", {"tuning": 128, "reference": 256, "audit": 256}, 7
    )
    return rows.select("user_id", "event_id", "part")


@query(
    "hist_duplicate_queries",
    """with d as (select lang, text, doc_id,
         cast('0x' || substr(sha256(cast(doc_id as varchar)), 1, 12) as bigint) % 1000 < 700 as train from documents)
       select v.doc_id from d v where not v.train and exists (select 1 from d t where t.train and t.lang = v.lang and t.text = v.text)""",
)
def hist_duplicate_queries(spark, sf):
    docs = T.table(spark, sf, "documents").select(
        "doc_id", F.array("lang", F.lit("d")).alias("history"), "text",
        (stable_bucket("doc_id", 1000) < 700).alias("train"),
    )
    found = H.duplicate_queries(docs.filter("train"), docs.filter("not train"), ["history", "text"])
    return found.select("doc_id")


@query(
    "hist_nuisance_features",
    """with c as (select item_id, ln(1 + count(*)) as lp from buy where "timestamp" < 946684800 group by item_id)
       select h.event_id, len(history) / 20.0 as share,
         round(coalesce(c.lp, 0.0) / greatest((select max(lp) from c), 1.0), 6) as pop,
         cast('0x' || substr(sha256(cat.brand), 1, 12) as bigint) % 8 as bucket
       from hist h left join c on c.item_id = h.item_id join cat on cat.item_id = h.item_id""",
    "hist cat buy",
)
def hist_nuisance_features(spark, sf):
    lengths = T.hist(spark, sf).select("event_id", "item_id", F.size("history").alias("length"))
    rows = lengths.join(T.cat(spark, sf).select("item_id", "brand"), "item_id")
    train = T.buy(spark, sf).filter(F.col("timestamp") < T.TRAIN_END)
    out = H.nuisance_features(rows, train, 20, F.lit(1), F.col("brand"), F.col("length"))
    return out.select(
        "event_id", F.col("nuisance")[2].alias("share"), r(F.col("nuisance")[3]).alias("pop"),
        (F.array_position(F.slice("nuisance", 5, 8), F.lit(1.0)) - 1).alias("bucket"),
    )


@query(
    "hist_render_prompts",
    """select h.event_id,
         'Recommend the next item for this user. Return exactly one item SID.' || chr(10) ||
         'Earlier interactions, in chronological order:' || chr(10) || coalesce(array_to_string(list_transform(history, lambda x: x.i), ' '), '') as rec,
         'Scene: ' || domain || chr(10) || 'Earlier items: ' || coalesce(array_to_string(list_transform(history, lambda x: x.i), '; '), '') ||
           chr(10) || 'Candidate: ' || item_id || chr(10) || 'Predict user feedback.' as feedback from ehist h""",
    "ehist",
)
def hist_render_prompts(spark, sf):
    return T.ehist(spark, sf).select(
        "event_id", H.recommendation_prompt(T.items()).alias("rec"),
        H.feedback_prompt(F.col("domain"), T.items(), F.col("item_id")).alias("feedback"),
    )


@query(
    "hist_grounding_prompts",
    """select doc_id, 'Identify the item from its description. Return exactly one item SID.' || chr(10) || 'Title: ' || lang || chr(10) ||
         'Categories: ' || source || chr(10) || 'Description: ' || substr(trim(text), 1, 320) as prompt from documents""",
)
def hist_grounding_prompts(spark, sf):
    """The 320-character cut of the description is the prompt's own rule."""
    docs = T.table(spark, sf, "documents")
    return docs.select("doc_id", H.grounding_prompt(F.col("lang"), F.col("source"), F.col("text")).alias("prompt"))


@query(
    "hist_prompt_leaks",
    """select cast(doc_id as varchar) as record_id, case when contains(text, lang) then 'answer' else 'code' end as reason
       from documents where contains(text, lang) or regexp_matches(text, '<s_[a-d]_[0-9]+>')""",
)
def hist_prompt_leaks(spark, sf):
    docs = T.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("record_id"), F.col("text").alias("prompt"), F.col("lang").alias("answer"),
        F.lit("ground").alias("task"),
    )
    return H.prompt_leaks(docs)


_CODES = """codes as (select item_id, cast(substr(brand, 7) as integer) as c1, size as c2,
       cast('0x' || substr(sha256(category), 1, 12) as bigint) % 16 as c3 from cat)"""


def _codes(spark, sf):
    return T.cat(spark, sf).select(
        "item_id", "domain", F.expr("cast(substr(brand, 7) as int)").alias("c1"), F.col("size").alias("c2"),
        stable_bucket("category", 16).cast("int").alias("c3"),
    )


@query(
    "hist_namespace_catalog",
    f"""with {_CODES}, s as (select *, row_number() over (partition by c1, c2, c3 order by item_id) - 1 as suffix from codes)
       select item_id, suffix, suffix > 0 as collision,
         '<|sid_begin|><s_a_' || (c1 + 256) || '><s_b_' || (c2 + 256) || '><s_c_' || (c3 + 256) || '><s_d_' || (suffix + 256) || '><|sid_end|>' as sid from s""",
    "cat",
)
def hist_namespace_catalog(spark, sf):
    return K.namespace_catalog(_codes(spark, sf), 1).select("item_id", "suffix", "collision", "sid")


@query(
    "hist_repair_collisions",
    f"""with {_CODES}, k as (select item_id, c1, cast('0x' || substr(sha256(item_id), 1, 12) as bigint) % 16 as c4 from codes),
       dup as (select *, row_number() over (partition by c1, c4 order by item_id) as d from k),
       ranked as (select *, row_number() over (partition by c1 order by c4, item_id) as rk from dup where d > 1),
       free as (select c1, f, row_number() over (partition by c1 order by f) as rk from
         (select distinct c1 from k), (select unnest(range(256)) as f) where (c1, f) not in (select c1, c4 from k))
       select r.item_id, r.c4 as old_code, cast(free.f as integer) as new_code from ranked r left join free using (c1, rk)""",
    "cat",
)
def hist_repair_collisions(spark, sf):
    items = _codes(spark, sf).select(
        "item_id", "c1", F.lit(0).alias("c2"), F.lit(0).alias("c3"), stable_bucket("item_id", 16).alias("c4")
    )
    return K.repair_collisions(items)


@query(
    "hist_assemble_supervision",
    """select record_id, array_to_string(list_concat(list_slice(prompt_ids, -greatest(60 - len(response_ids), 0), -1), response_ids), ',') as input_ids,
         array_to_string(list_concat(list_transform(list_slice(prompt_ids, -greatest(60 - len(response_ids), 0), -1), lambda x: -100), response_ids), ',') as labels
       from (select * replace (case when len(response_ids) >= 60 then [] else prompt_ids end as prompt_ids) from encoded)""",
    "encoded",
)
def hist_assemble_supervision(spark, sf):
    ids, labels = H.assemble_supervision(F.col("prompt_ids"), F.col("response_ids"), 60)
    return T.encoded(spark, sf).select(
        "record_id", F.array_join(ids.cast("array<string>"), ",").alias("input_ids"),
        F.array_join(labels.cast("array<string>"), ",").alias("labels"),
    )


@query(
    "hist_split_counts",
    """with g as (select * from (values ('opening'), ('followup'), ('grounding'), ('*')) t(task),
                (values ('train'), ('select'), ('tune'), ('audit'), ('holdout'), ('*')) s(split)),
       c as (select coalesce(domain, '*') as task, coalesce(split, '*') as split, count(*) as n, count(distinct user_id) as users
             from sft_all group by cube (domain, split))
       select task, split, coalesce(n, 0) as n, coalesce(users, 0) as users, coalesce(n, 0) = 0 as empty from g left join c using (task, split)""",
    "sft_all",
)
def hist_split_counts(spark, sf):
    rows = T.sft_all(spark, sf).select(F.col("domain").alias("task"), "split", "user_id")
    return H.split_counts(rows, ["opening", "followup", "grounding"], ["train", "select", "tune", "audit", "holdout"])


@query(
    "hist_user_overlap",
    """with s as (select distinct user_id, split from sft_all)
       select a.split as a, b.split as b, count(*) as users from s a join s b on a.user_id = b.user_id and a.split < b.split group by all""",
    "sft_all",
)
def hist_user_overlap(spark, sf):
    return H.user_overlap(T.sft_all(spark, sf))


@query(
    "hist_population_audit",
    """with p as (select user_id, len(history) as hl from hist where len(history) > 0),
       u as (select user_id, count(*) as n from p group by user_id),
       top as (select cast(ceil(count(*) * 0.1) as bigint) as t from u)
       select (select count(*) from u) as users, (select count(*) from p) as positions,
         round((select avg(n) from u), 6) as mean_per_user, (select quantile_cont(n, 0.5) from u) as median_per_user,
         (select max(n) from u) as max_per_user,
         round((select sum(n) from (select n, row_number() over (order by n desc) as rn from u) where rn <= (select t from top)) / (select count(*) from p), 6) as top10_share,
         round((select avg(case when hl = 1 then 1.0 else 0.0 end) from p), 6) as share_len_1,
         round((select avg(case when hl <= 2 then 1.0 else 0.0 end) from p), 6) as share_len_le_2,
         round((select avg(hl) from p), 6) as mean_history""",
    "hist",
)
def hist_population_audit(spark, sf):
    positions = T.hist(spark, sf).filter(F.size("history") > 0).select("user_id", F.size("history").alias("history_len"))
    out = H.population_audit(positions)
    rounded = ["mean_per_user", "top10_share", "share_len_1", "share_len_le_2", "mean_history"]
    return out.select(*[r(c).alias(c) if c in rounded else F.col(c) for c in out.columns])
