"""Records: contracts, keys, leaks, fingerprints, logs and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions.keys import stable_bucket
from winnow.operators import contracts as C
from winnow.sources import readers as R
from workload import tables as T
from workload.registry import query, r


@query(
    "src_read_sft",
    """select split, count(*) as records, cast(sum(len(input_ids)) as bigint) as tokens, cast(sum(cost) as bigint) as cost
       from sft group by split""",
    "sft",
)
def src_read_sft(spark, sf):
    """Write the records as JSON lines, read them back through the checked reader, and count."""
    import uuid

    from winnow.plans.cut import checkpoint_folder

    path = f"{checkpoint_folder(spark)}/winnow/{uuid.uuid4().hex}"
    columns = [c.split()[0] for c in R.schemas.SFT.split(", ")]
    R.write_records(T.sft(spark, sf).select(*columns), path)
    rows = R.read_sft(spark, path)
    return rows.groupBy("split").agg(
        F.count("*").alias("records"), F.sum(F.size("input_ids")).alias("tokens"),
        F.sum(C.response_cost("labels")).alias("cost"),
    )


@query(
    "src_sft_violations",
    """select record_id, unnest(list_filter([case when split = 'holdout' then 'split' end,
         case when len(input_ids) < 2 then 'length' end, case when cost = 0 then 'cost' end],
         lambda x: x is not null)) as rule from sft_all""",
    "sft_all",
)
def src_sft_violations(spark, sf):
    return C.sft_violations(T.sft_all(spark, sf))


@query("src_response_cost", "select record_id, cost from sft_all", "sft_all")
def src_response_cost(spark, sf):
    return T.sft_all(spark, sf).select("record_id", C.response_cost("labels").alias("cost"))


@query("src_record_keys", "select record_id, cost, cell, content_id, provenance_group from sft_all_keys", "sft_all_keys")
def src_record_keys(spark, sf):
    return T.sft_keyed(spark, sf).select("record_id", "cost", "cell", "content_id", "provenance_group")


@query(
    "src_table_violations",
    """select 'duplicate_record_id' as rule, root_id as key, count(*) as n from sft_all group by root_id having count(*) > 1
       union all select 'mixed_recipe', '', n from (select count(distinct domain) as n from sft_all) where n > 1""",
    "sft_all",
)
def src_table_violations(spark, sf):
    """Conversation ids taken as record ids and domains as recipes: both rules must fire."""
    rows = T.sft_all(spark, sf).select(F.col("root_id").alias("record_id"), F.col("domain").alias("recipe_id"))
    return C.table_violations(rows)


_DOC_SPLIT = "case when b < 700 then 'train' when b < 800 then 'select' when b < 900 then 'tune' else 'test' end"


@query(
    "src_partition_leaks",
    f"""with d as (select cast(doc_id as varchar) as record_id, 'root' || (doc_id // 3) as root_id, sha256(text) as content_id,
           source as user_id, {_DOC_SPLIT} as split, case when lang = 'en' then 'en' else 'other' end as recipe_id
         from (select *, cast('0x' || substr(sha256(cast(doc_id as varchar)), 1, 12) as bigint) % 1000 as b from documents)),
       k as (select 'record' as kind, record_id as key, split from d union all select 'root', root_id, split from d
             union all select 'content', content_id, split from d
             union all select 'user', user_id, split from d where split <> 'train')
       select kind, key, array_to_string(list_sort(list(distinct split)), ',') as splits from k group by kind, key
         having count(distinct split) > 1
       union all select 'recipe', recipe_id, array_to_string(list_sort(list(distinct split)), ',') from d group by recipe_id""",
)
def src_partition_leaks(spark, sf):
    b = stable_bucket("doc_id", 1000)
    split = F.when(b < 700, "train").when(b < 800, "select").when(b < 900, "tune").otherwise("test")
    docs = T.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("record_id"),
        F.concat(F.lit("root"), F.floor(F.col("doc_id") / 3).cast("string")).alias("root_id"),
        F.sha2("text", 256).alias("content_id"), F.col("source").alias("user_id"), split.alias("split"),
        F.when(F.col("lang") == "en", "en").otherwise("other").alias("recipe_id"),
    )
    return C.partition_leaks(docs)


_LANE = "cast(sum(cast(cast('0x' || substr(h, {at}, 12) as bigint) as hugeint)) % 281474976710656 as bigint)"


@query(
    "src_table_fingerprint",
    f"""select count(*) as "rows", {_LANE.format(at=1)} as lane_a, {_LANE.format(at=13)} as lane_b
       from (select sha256(concat_ws('|', record_id, root_id, cell, split, content_id)) as h from sft_all_keys)""",
    "sft_all_keys",
)
def src_table_fingerprint(spark, sf):
    return C.table_fingerprint(T.sft_keyed(spark, sf))


def _feedback_records(spark, sf):
    rows = T.feedback(spark, sf)
    split = F.when(F.col("n_chars") < 400, "train").when(F.col("n_chars") < 2000, "selection").otherwise("test")
    return rows.select(
        F.col("id").alias("record_id"), F.col("scene").alias("user_id"), F.col("id").alias("item_id"),
        F.array(F.col("n_chars") - 200.0, F.lit(100.0)).alias("history_times"), F.array("scene", "scene").alias("history"),
        F.col("n_chars").alias("timestamp"), F.array("quality", "toxic").alias("labels"), split.alias("split"), "scene",
        (F.col("n_chars") / 4000.0).alias("propensity"),
    )


@query(
    "src_feedback_violations",
    """select id as record_id, unnest(list_filter([
         case when not (n_chars - 200 < n_chars and 100 < n_chars) then 'strict_history' end,
         case when n_chars - 200 > 100 then 'sorted_history' end,
         case when quality is null and toxic is null then 'observed_label' end,
         case when n_chars / 4000.0 > 1 or n_chars <= 0 then 'propensity' end], lambda x: x is not null)) as rule from feedback""",
    "feedback",
)
def src_feedback_violations(spark, sf):
    return C.feedback_violations(_feedback_records(spark, sf))


@query(
    "src_split_boundary_report",
    """with f as (select *, case when quality is null then 'train' when toxic = 1 then 'test' else 'selection' end as split from feedback),
       s as (select split, min(n_chars) as lo, max(n_chars) as hi from f group by split)
       select 'overlap' as rule, x.split as a, y.split as b from s x join s y
         on (x.split, y.split) in (('train', 'selection'), ('train', 'test'), ('selection', 'test')) and x.hi >= y.lo
       union all select 'label_width', '', '' from (select 1) where (select count(distinct case when quality is null then 1 else 2 end) from f) > 1""",
    "feedback",
)
def src_split_boundary_report(spark, sf):
    split = F.when(F.col("quality").isNull(), "train").when(F.col("toxic") == 1, "test").otherwise("selection")
    labels = F.when(F.col("quality").isNull(), F.array("quality")).otherwise(F.array("quality", "toxic"))
    rows = T.feedback(spark, sf).select(split.alias("split"), F.col("n_chars").alias("timestamp"), labels.alias("labels"))
    return C.split_boundary_report(rows)


_LOG = """log as (select user_id, item_id as video_id, cast("timestamp" as varchar) as time_ms, domain as tab, event_id,
     case when value < 20 then '-1' when value < 60 then '1' else '0' end as is_click,
     case when value < 40 then '' when value < 50 then '1' else '0' end as is_like from ev)"""


@query(
    "src_feedback_log_to_records",
    f"""with {_LOG},
       u as (select user_id, list({{'t': cast(time_ms as double), 'e': event_id, 'i': video_id}} order by cast(time_ms as double), event_id) as al
             from log group by user_id),
       h as (select log.*, list_slice(list_filter(al, lambda x: x.t < cast(time_ms as double)), -20, -1) as history
             from log join u using (user_id))
       select user_id, video_id as item_id, tab as scene, cast(time_ms as double) as "timestamp",
         coalesce(array_to_string(list_transform(history, lambda x: x.i), ','), '') as history,
         case when cast(time_ms as double) < 1705795200 then 'train' when cast(time_ms as double) < 1706227200 then 'selection' else 'test' end as split,
         case when is_click <> '-1' then cast(is_click as double) end as click,
         case when is_like <> '' then cast(is_like as double) end as liked
       from h where is_click <> '-1' or is_like <> ''""",
    "ev",
)
def src_feedback_log_to_records(spark, sf):
    v = F.col("value")
    log = T.ev(spark, sf).select(
        "user_id", F.col("item_id").alias("video_id"), F.col("timestamp").cast("string").alias("time_ms"),
        F.col("domain").alias("tab"), "event_id",
        F.when(v < 20, "-1").when(v < 60, "1").otherwise("0").alias("is_click"),
        F.when(v < 40, "").when(v < 50, "1").otherwise("0").alias("is_like"),
    )
    rows = R.feedback_log_to_records(log, T.EVENT_TRAIN_END, T.EVENT_SELECT_END, 20, tie="event_id")
    return rows.select(
        "user_id", "item_id", "scene", "timestamp", F.array_join("history", ",").alias("history"), "split",
        F.col("labels")[0].alias("click"), F.col("labels")[1].alias("liked"),
    )


@query(
    "src_log_duplicates",
    """select user_id, item_id as video_id, cast("timestamp" as varchar) as time_ms, domain as tab, count(*) as n
       from ev group by all having count(*) > 1""",
    "ev",
)
def src_log_duplicates(spark, sf):
    return R.log_duplicates(
        T.ev(spark, sf).select(
            "user_id", F.col("item_id").alias("video_id"), F.col("timestamp").cast("string").alias("time_ms"),
            F.col("domain").alias("tab"),
        )
    )


@query(
    "src_normalize_reviews",
    """select sha256('["retail","' || o_custkey || '","' || l_partkey || '",' || cast(epoch(l_shipdate) as bigint) || ']') as event_id,
         cast(o_custkey as varchar) as user_id, cast(l_partkey as varchar) as item_id, cast(epoch(l_shipdate) as bigint) as "timestamp",
         'retail' as domain, l_quantity as rating
       from lineitem join orders on l_orderkey = o_orderkey""",
)
def src_normalize_reviews(spark, sf):
    lines = T.table(spark, sf, "lineitem")
    orders = T.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    raw = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("user_id"), F.col("l_partkey").cast("string").alias("parent_asin"),
        T.day("l_shipdate").cast("string").alias("timestamp"), F.col("l_quantity").alias("rating"),
    )
    return R.normalize_reviews(raw, "retail")


@query(
    "src_read_sid_split",
    """select domain as task, split, count(*) as n, cast(sum(cost) as bigint) as cost from sft
       where split = 'tune' and domain = 'followup' group by all""",
    "sft",
)
def src_read_sid_split(spark, sf):
    """Partitioned by task and split: the scan lists only the directory asked for."""
    import uuid

    from winnow.plans.cut import checkpoint_folder

    path = f"{checkpoint_folder(spark)}/winnow/{uuid.uuid4().hex}"
    named = T.sft(spark, sf).select(
        "record_id", F.col("domain").alias("task"),
        F.when(F.col("split") == "tune", "calibration").when(F.col("split") == "select", "selection")
        .when(F.col("split") == "audit", "test").otherwise(F.col("split")).alias("split"), "cost",
    )
    R.write_records(named, path, "parquet", ("task", "split"))
    rows = R.read_sid_split(spark, path, "calibration", "followup")
    return rows.groupBy("task", F.lit("tune").alias("split")).agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


@query(
    "src_upstream_unknown_items",
    """with h as (select event_id, item_id, list_slice(list_transform(history, lambda x: x.i), -10, -1) as hh from hist where len(history) > 0)
       select u.item_id, count(*) as uses from
         (select unnest(list_append(hh, item_id)) as item_id from h) u
         left join (select item_id from cat where answer is not null) c on c.item_id = u.item_id
       where c.item_id is null group by u.item_id""",
    "hist cat",
)
def src_upstream_unknown_items(spark, sf):
    """History written as a Python list literal, parsed back, and checked against the catalog."""
    rows = T.hist(spark, sf).filter(F.size("history") > 0)
    literal = F.concat(F.lit("['"), F.array_join(T.items(), "', '"), F.lit("']"))
    parsed = R.parse_history_column(rows.select("item_id", literal.alias("history_item_id")), "history_item_id", 10)
    return R.unknown_items(parsed, T.cat(spark, sf).filter("answer is not null"))


@query(
    "src_plan_audit",
    """with p as (select record_id, record_id || '#1' as occurrence_id, cost, len(input_ids) as n, split, content_id from sft_keys
                 union all select record_id, record_id || '#1', cost + 1, len(input_ids), split, content_id from sft_keys where domain = 'opening'),
       rep as (select occurrence_id from p group by 1 having count(*) > 1)
       select occurrence_id, 'response_tokens' as rule from p join sft_keys k using (record_id) where p.cost <> k.cost
       union all select occurrence_id, 'not_train' from p where split <> 'train'
       union all select occurrence_id, 'duplicate_occurrence' from rep""",
    "sft_keys",
)
def src_plan_audit(spark, sf):
    records = T.sft(spark, sf)
    plan = records.select(
        "record_id", F.concat("record_id", F.lit("#1")).alias("occurrence_id"), F.col("cost").alias("response_tokens"),
        F.size("input_ids").alias("input_tokens"), "cell", "content_id", "domain",
    )
    forged = plan.filter("domain = 'opening'").withColumn("response_tokens", F.col("response_tokens") + 1)
    return C.plan_audit(plan.unionByName(forged), records)


def _written(spark, rows, form: str, **options) -> str:
    """rows written to the checkpoint folder as files of a format."""
    import uuid

    from winnow.plans.cut import checkpoint_folder

    path = f"{checkpoint_folder(spark)}/winnow/{uuid.uuid4().hex}"
    rows.write.options(**options).format(form).save(path)
    return path


@query(
    "src_encode_table",
    """select record_id, split, len(input_ids) as tokens, cost, sha256(array_to_string(input_ids, ',')) as digest
       from (select * replace (case split when 'holdout' then 'test' else split end as split) from sft_all) where cost > 0""",
    "sft_all",
)
def src_encode_table(spark, sf):
    """Turns through the encoder table function: a turn without a response gives no record."""
    from winnow.sources.encoder import encode

    rows = encode(T.turns(spark, sf), "winnow.sources.encoder:words")
    ids = F.sha2(F.array_join(F.transform("input_ids", lambda i: i.cast("string")), ","), 256)
    return rows.select("record_id", "split", F.size("input_ids").alias("tokens"), C.response_cost("labels").alias("cost"), ids.alias("digest"))


@query(
    "src_read_feedback",
    """select user_id, count(*) as records, round(sum(timestamp), 6) as times, cast(sum(len(history)) as bigint) as items from
         (select scene as user_id, n_chars as timestamp, [scene, scene] as history from feedback
          where quality is not null and n_chars > 300 and n_chars <= 4000) group by 1""",
    "feedback",
)
def src_read_feedback(spark, sf):
    """Feedback records written as JSON lines and read back through the checked reader."""
    rows = _feedback_records(spark, sf).filter("labels[0] is not null and timestamp > 300 and timestamp <= 4000").withColumn(
        "history_times", F.array(F.lit(100.0), F.col("timestamp") - 200.0)).withColumn("prompt", F.lit("")).withColumn("source", F.lit("log"))
    columns = [c.split()[0] for c in R.schemas.FEEDBACK.split(", ")]
    back = R.read_feedback(spark, _written(spark, rows.select(*columns), "json"))
    return back.groupBy("user_id").agg(
        F.count("*").alias("records"), r(F.sum("timestamp")).alias("times"), F.sum(F.size("history")).alias("items"))


@query(
    "src_read_feedback_log",
    """select event_type as tab, count(*) as rows, count(distinct user_id) as users, cast(sum(case when event_id % 3 = 0 then 1 else 0 end) as bigint) as unknown,
         cast(sum(case when event_id % 3 = 0 then null else event_id % 2 end) as double) as clicks from events group by 1""",
)
def src_read_feedback_log(spark, sf):
    """Events written as a csv log with a header, read back, its spellings of unknown labels turned to null."""
    events = T.table(spark, sf, "events")
    number = F.col("event_id").cast("bigint")
    spelling = F.element_at(F.array(F.lit("-1"), F.lit("nan"), F.lit("None")), (number % 9 / 3).cast("int") + 1)
    click = F.when(number % 3 == 0, spelling).otherwise((number % 2).cast("string"))
    rows = events.select(
        F.col("user_id").cast("string").alias("user_id"), number.cast("string").alias("video_id"), F.unix_millis(F.to_timestamp("ts")).cast("string").alias("time_ms"),
        F.col("event_type").alias("tab"), click.alias("is_click"), F.lit("0").alias("is_like"))
    back = R.read_feedback_log(spark, _written(spark, rows, "csv", header=True))
    label = R.known_label("is_click")
    return back.groupBy("tab").agg(
        F.count("*").alias("rows"), F.countDistinct("user_id").alias("users"), F.sum(F.when(label.isNull(), 1).otherwise(0)).alias("unknown"),
        r(F.sum(label)).alias("clicks"))


@query(
    "src_read_reviews",
    """with e as (select cast(user_id as varchar) as u, cast(event_id % 500 as varchar) as i, epoch(cast(cast(ts as date) as timestamp)) as t, event_id % 5 + 1 as rating from events)
       select i as item_id, count(*) as reviews, count(distinct u || ' ' || t) as times, cast(sum(rating) as double) as rating from e group by 1""",
)
def src_read_reviews(spark, sf):
    """Reviews written as gzip JSON lines, read back and normalised."""
    number = F.col("event_id").cast("bigint")
    rows = T.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("user_id"), (number % 500).cast("string").alias("parent_asin"), T.day("ts").alias("timestamp"),
        (number % 5 + 1).cast("double").alias("rating"))
    back = R.read_reviews(spark, _written(spark, rows, "json", compression="gzip"), "log")
    at = F.concat_ws(" ", "user_id", "timestamp")
    return back.groupBy("item_id").agg(F.count("*").alias("reviews"), F.countDistinct(at).alias("times"), r(F.sum("rating")).alias("rating"))


@query(
    "src_read_upstream_csv",
    """with h as (select o_custkey as c, list(cast(o_orderkey as varchar) order by o_orderkey) as h from orders group by 1)
       select c as user_id, array_to_string(list_slice(h, greatest(len(h) - 4, 1), len(h)), ' ') as history from h""",
)
def src_read_upstream_csv(spark, sf):
    """Histories written as list literals in csv cells, read back, the last five items kept."""
    orders = T.table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("h"))
    quoted = F.transform("h", lambda k: F.concat(F.lit("'"), k.cast("string"), F.lit("'")))
    rows = orders.select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")).alias("history_item_id"))
    back = R.parse_history_column(R.read_upstream_csv(spark, _written(spark, rows, "csv", header=True, escape='"')), "history_item_id", 5)
    return back.select(F.col("user_id").cast("bigint").alias("user_id"), F.array_join("history", " ").alias("history"))


@query(
    "src_lines_pushed",
    """select p_brand as brand, count(*) as parts, cast(sum(p_size) as bigint) as size from part where p_size >= 40 and p_brand <> 'Brand#11' group by 1""",
)
def src_lines_pushed(spark, sf):
    """Parts written as JSON lines, read through the line source, which applies the filter on size itself."""
    from winnow.sources.lines import read_where

    rows = T.table(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_size").cast("bigint").alias("p_size"))
    kept = read_where(spark, _written(spark, rows, "json"), "p_brand string, p_size bigint", "p_size >= 40 and p_brand <> 'Brand#11'")
    return kept.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("parts"), F.sum("p_size").alias("size"))
