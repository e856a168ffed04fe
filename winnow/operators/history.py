"""Strict histories, tasks, splits and prompts."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.keys import json_array, json_list, json_text, seeded, stable_bucket
from winnow.plans.cut import cut
from winnow.plans.ordered import hot_keys, last_items, top_per_group, with_previous, with_row_number
from winnow.schemas import MASKED


def strict_history(
    events: DataFrame, keys: Sequence[str], t: str, item: Column, h: int, tie: Sequence[str], count_on: DataFrame | None = None
) -> DataFrame:
    """Add history: the last h items of the same key with a strictly earlier time, oldest first.

    Rows with equal times share one history; a row without a key or time has none. Each key is sorted once, in one shuffle of
    the rows; a key with more than `spark.winnow.hotRows` rows goes by blocks of (key, time) instead. Key sizes are counted on
    `count_on`, a cheaper table with at least as many rows per key; without it, on the events, which should then be written down.
    """
    hot = hot_keys((events if count_on is None else count_on).select(*keys), keys)
    if hot is None:
        return _history_by_key(events, keys, t, item, h, tie)
    events, hot = cut(events), hot.drop("_n")
    few = _history_by_key(events.join(hot, keys, "left_anti").select(*events.columns), keys, t, item, h, tie)
    many = _history_by_block(events.join(hot, keys, "left_semi").select(*events.columns), keys, t, item, h, tie)
    return few.unionByName(many)


def _history_by_key(events: DataFrame, keys: Sequence[str], t: str, item: Column, h: int, tie: Sequence[str]) -> DataFrame:
    """A key's rows in order look h rows back; rows tied in time share what the first of them sees. Both windows use one sort."""
    # rows without a key share nothing with each other, so they need not meet in one task
    lost = functools.reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    events = events.withColumn("_lost", F.when(lost, F.pmod(F.xxhash64(*tie), F.lit(1024))))
    key = [*keys, "_lost"]
    order = [F.col(c) for c in tie]
    back = Window.partitionBy(*key).orderBy(F.col(t), *order).rowsBetween(-h, -1)
    tied = Window.partitionBy(*key, t).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # an item that is null still counts, so items are gathered inside a struct, which is none
    bare = events.select(item.alias("_item")).schema["_item"].nullable
    past = F.collect_list(F.struct(item.alias("v")) if bare else item).over(back)
    rows = events.withColumn("_past", past).withColumn("_past", F.first("_past").over(tied))
    past = F.transform("_past", lambda x: x["v"]) if bare else F.col("_past")
    return rows.withColumn("history", F.when(F.col("_lost").isNull() & F.col(t).isNotNull(), past)).drop("_past", "_lost")


def _history_by_block(events: DataFrame, keys: Sequence[str], t: str, item: Column, h: int, tie: Sequence[str]) -> DataFrame:
    """Each (key, time) block hands on only its last h items, which suffices because any later row needs at most h.

    The block table then looks h blocks back, and a join on (key, time) returns the result to the rows, so that neither a hot key
    nor a hot instant is ever gathered in one array.
    """
    slim = events.select(*keys, t, item.alias("_item"), *tie)
    newest = [F.col(c).desc() for c in tie]
    ends = top_per_group(slim, [*keys, t], newest, h, "_back")
    blocks = ends.groupBy(*keys, t).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("o"), F.col("_item").alias("v")))),
            lambda s: s["v"],
        ).alias("_block")
    )
    past = with_previous(blocks, keys, [F.col(t)], "_block", h, "_past", count_on=events.select(*keys))
    past = past.select(*[F.col(c).alias(f"_k_{c}") for c in [*keys, t]], last_items(F.flatten("_past"), h).alias("history"))
    cond = F.lit(True)
    for c in [*keys, t]:
        cond = cond & (F.col(c) == F.col(f"_k_{c}"))
    return events.join(past, cond, "left").drop(*[f"_k_{c}" for c in [*keys, t]])


def event_violations(events: DataFrame) -> DataFrame:
    """Event ids that occur more than once."""
    return events.groupBy("event_id").agg(F.count("*").alias("n")).filter("n > 1")


def with_history(events: DataFrame, h: int = 20, count_on: DataFrame | None = None) -> DataFrame:
    """Events of (domain, user) with their strict history of (item_id, timestamp)."""
    return strict_history(
        events, ["domain", "user_id"], "timestamp", F.struct("item_id", "timestamp"), h, ["event_id"], count_on
    )


def task_rows(events: DataFrame, catalog: DataFrame, h: int = 20, count_on: DataFrame | None = None) -> DataFrame:
    """Events with the catalog's answer, category and title, and a history that carries them too.

    The catalog is joined once per event, before the history is built, instead of once per history
    item; the tasks below are then projections of one row.
    """
    known = catalog.select("domain", "item_id", "answer", "category", "title")
    rows = events.join(known, ["domain", "item_id"], "left").withColumn("answer", F.coalesce("answer", "item_id"))
    item = F.struct("item_id", "timestamp", "answer", "category")
    # the catalog adds rows only where it has an item twice, so the events tell which keys are hot enough
    return strict_history(rows, ["domain", "user_id"], "timestamp", item, h, ["event_id"], events if count_on is None else count_on)


def time_split(t: Column | str, train_end, select_end, middle: str = "select") -> Column:
    c = F.col(t) if isinstance(t, str) else t
    return F.when(c < train_end, F.lit("train")).when(c < select_end, F.lit(middle)).otherwise(F.lit("test"))


def prompt_text(past: Column, ask: str) -> Column:
    return F.concat(F.lit("History: "), json_list(past), F.lit("\n" + ask))


def _part(name: str) -> Column:
    return F.transform("history", lambda x: x[name])


def next_item_task(rows: DataFrame, train_end: int, select_end: int) -> DataFrame:
    """One row per event that has a history; rows come from task_rows."""
    return rows.filter(F.size("history") > 0).select(
        F.concat("event_id", F.lit(":next")).alias("record_id"),
        F.col("event_id").alias("root_id"),
        "domain",
        F.lit("temporal_events").alias("source"),
        time_split("timestamp", train_end, select_end).alias("split"),
        "user_id",
        F.col("timestamp").alias("target_timestamp"),
        _part("timestamp").alias("history_timestamps"),
        F.lit("next_item").alias("task"),
        prompt_text(_part("answer"), "Recommend the next item.").alias("input_text"),
        F.col("answer").alias("output_text"),
        F.lit("observed").alias("label_origin"),
    )


def most_frequent(values: Column) -> Column:
    """The most frequent element of a short array, ties by the smallest; null when it is empty."""
    counted = F.transform(F.array_distinct(values), lambda c: F.struct((-F.size(F.filter(values, lambda x: x == c))).alias("n"), c.alias("c")))
    return F.array_min(counted)["c"]


def history_category_task(rows: DataFrame, train_end: int, select_end: int) -> DataFrame:
    """Train rows only: the most frequent category of the history, ties by name."""
    cats = F.filter(_part("category"), lambda c: c.isNotNull() & (c != ""))
    train = rows.filter((F.size("history") > 0) & (F.col("timestamp") < train_end)).withColumn("_cats", cats)
    return train.filter(F.size("_cats") > 0).select(
        F.concat("event_id", F.lit(":history_category")).alias("record_id"),
        F.col("event_id").alias("root_id"),
        "domain",
        F.lit("temporal_events").alias("source"),
        time_split("timestamp", train_end, select_end).alias("split"),
        "user_id",
        F.lit("history_category_summary").alias("task"),
        prompt_text(_part("answer"), "Return its most frequent recorded category.").alias("input_text"),
        most_frequent(F.col("_cats")).alias("output_text"),
        F.lit("history-derived-not-user-intent").alias("label_origin"),
    )


def id_to_title_task(rows: DataFrame, catalog: DataFrame, train_end: int) -> DataFrame:
    """One train row per catalog item with a title that a training row shows or targets."""
    rows = rows.filter((F.size("history") > 0) & (F.col("timestamp") < train_end))
    # Repeats are dropped map-side, so at most one row per item leaves a task.
    seen = rows.select("domain", F.explode(F.array_append(_part("item_id"), F.col("item_id"))).alias("item_id")).distinct()
    titled = catalog.filter(F.length("title") > 0)
    root = F.sha2(json_array(json_text(F.lit("catalog")), json_text("domain"), json_text("item_id")), 256)
    return seen.join(titled, ["domain", "item_id"]).select(
        F.concat(root, F.lit(":id_title")).alias("record_id"),
        root.alias("root_id"),
        "domain",
        F.lit("item_metadata").alias("source"),
        F.lit("train").alias("split"),
        F.lit("id_to_title").alias("task"),
        F.concat(F.lit("Describe item "), F.coalesce("answer", "item_id")).alias("input_text"),
        F.col("title").alias("output_text"),
        F.lit("observed-metadata").alias("label_origin"),
    )


def leave_last_split(events: DataFrame, user: str, order: Sequence[str]) -> DataFrame:
    """Third-last event to train, second-last to selection or calibration by user hash, last to test.

    Only users with at least five events take part. Five rows per user are enough to know both
    the split and the minimum, so the group limit is pushed below the shuffle.
    """
    last = top_per_group(events, [user], [F.col(c).desc() for c in order], 5, "_rn")
    enough = last.filter("_rn = 5").select(user)
    middle = F.when(stable_bucket(user, 2) == 0, F.lit("selection")).otherwise(F.lit("calibration"))
    split = F.when(F.col("_rn") == 3, F.lit("train")).when(F.col("_rn") == 2, middle).otherwise(F.lit("test"))
    return last.filter("_rn <= 3").join(enough, user, "left_semi").withColumn("split", split).drop("_rn")


def hash_split(key: Column | str) -> Column:
    """700/100/100/100 per mille by stable bucket."""
    b = stable_bucket(key, 1000)
    return (
        F.when(b < 700, F.lit("train")).when(b < 800, F.lit("selection"))
        .when(b < 900, F.lit("calibration")).otherwise(F.lit("test"))
    )


def one_query_per_user(queries: DataFrame, user: str, query: str, sizes: dict[str, int], seed: int) -> DataFrame:
    """One query per user, users in hash order, in consecutive disjoint parts of the given sizes."""
    columns = queries.columns
    picked = queries.groupBy(user).agg(F.min_by(F.struct(*columns), seeded(seed, user, query)).alias("q"))
    picked = cut(picked.select("q.*").withColumn("_h", seeded(seed, user)))
    total = sum(sizes.values())
    # Only digests and users are numbered, in ordered slices where they are many.
    numbered = with_row_number(picked.select("_h", F.col(user).alias("_u")), [], [F.col("_h"), F.col("_u")], "_rn").filter(F.col("_rn") <= total)
    ranked = picked.join(numbered.drop("_h"), F.col(user) == F.col("_u")).drop("_u")
    part, upto = F.lit(None).cast("string"), 0
    bounds = []
    for name, n in sizes.items():
        bounds.append((upto + n, name))
        upto += n
    for end, name in reversed(bounds):
        part = F.when(F.col("_rn") <= end, F.lit(name)).otherwise(part)
    return ranked.withColumn("part", part).drop("_h", "_rn")


def duplicate_queries(train: DataFrame, valid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of valid whose keys (user, history, target) all occur in train.

    Only a digest of the keys is shuffled, not the texts or arrays themselves.
    """
    digest = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    seen = train.select(digest.alias("_digest")).distinct()
    return valid.withColumn("_digest", digest).join(seen, "_digest", "left_semi").drop("_digest")


def popularity(events: DataFrame) -> DataFrame:
    return events.groupBy("item_id").agg(F.count("*").alias("popularity"))


def nuisance_features(
    records: DataFrame, train_events: DataFrame, h: int, task_flag: Column, first_code: Column, length: Column | None = None
) -> DataFrame:
    """Add nuisance: 1, task flag, history share, scaled log popularity and an 8-way one-hot.

    Records are shuffled to their item's popularity; those that come with the length of their history need not carry the history.
    """
    counts = popularity(train_events).withColumn("_log", F.log1p("popularity"))
    peak = F.greatest(counts.agg(F.max("_log").alias("m")).scalar(), F.lit(1.0))
    rows = records.join(counts.select("item_id", "_log"), "item_id", "left")
    bucket = stable_bucket(first_code, 8)
    onehot = [F.when(bucket == j, F.lit(1.0)).otherwise(F.lit(0.0)) for j in range(8)]
    features = F.array(
        F.lit(1.0), task_flag.cast("double"), (F.size("history") if length is None else length) / F.lit(float(h)),
        F.coalesce("_log", F.lit(0.0)) / peak, *onehot,
    )
    return rows.withColumn("nuisance", features).drop("_log")


def recommendation_prompt(sids: Column) -> Column:
    # The wording of the prompts.
    head = "Recommend the next item for this user. Return exactly one item SID.\nEarlier interactions, in chronological order:\n"
    return F.concat(F.lit(head), F.array_join(sids, " "))


def grounding_prompt(title: Column, categories: Column, description: Column) -> Column:
    def text(c: Column) -> Column:
        return F.trim(F.coalesce(c, F.lit("")))

    return F.concat(
        F.lit("Identify the item from its description. Return exactly one item SID.\nTitle: "), text(title),
        F.lit("\nCategories: "), text(categories),
        F.lit("\nDescription: "), F.substring(text(description), 1, 320),
    )


def feedback_prompt(scene: Column, history: Column, candidate: Column) -> Column:
    return F.concat(
        F.lit("Scene: "), scene, F.lit("\nEarlier items: "), F.array_join(history, "; "),
        F.lit("\nCandidate: "), candidate, F.lit("\nPredict user feedback."),
    )


# Fixed value: the pattern of an item code.
SID_PATTERN = r"<s_[a-d]_\d+>"


def prompt_leaks(records: DataFrame) -> DataFrame:
    """Prompts that contain their own answer, or any item code in a metadata prompt."""
    own = F.col("prompt").contains(F.col("answer"))
    code = (F.col("task") == "ground") & F.col("prompt").rlike(SID_PATTERN)
    reason = F.when(own, F.lit("answer")).when(code, F.lit("code"))
    return records.withColumn("reason", reason).filter("reason is not null").select("record_id", "reason")


def assemble_supervision(prompt: Column, response: Column, max_len: int) -> tuple[Column, Column]:
    """input_ids and labels: the prompt is masked and cut on the left, the response is kept whole."""
    room = F.greatest(F.lit(max_len) - F.size(response), F.lit(0))
    kept = last_items_by(prompt, room)
    ids = F.concat(kept, response)
    labels = F.concat(F.array_repeat(F.lit(MASKED), F.size(kept)), response)
    return ids, labels


def last_items_by(column: Column, n: Column) -> Column:
    start = F.greatest(F.size(column) - n, F.lit(0)) + 1
    return F.slice(column, start, F.size(column))


def split_counts(records: DataFrame, tasks: Sequence[str], splits: Sequence[str]) -> DataFrame:
    """Rows and users per task and split with subtotals; an expected cell without rows shows as 0."""
    spark = records.sparkSession
    counted = records.cube("task", "split").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.grouping_id().alias("level")
    )
    counted = counted.withColumn("task", F.coalesce("task", F.lit("*"))).withColumn("split", F.coalesce("split", F.lit("*")))
    grid = spark.createDataFrame([(t, s) for t in [*tasks, "*"] for s in [*splits, "*"]], "task string, split string")
    return grid.join(counted, ["task", "split"], "left").select(
        "task", "split", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("users", F.lit(0)).alias("users"),
        F.coalesce("n", F.lit(0)).__eq__(0).alias("empty"),
    )


def user_overlap(records: DataFrame) -> DataFrame:
    """Users that occur in more than one split, per pair of splits."""
    sets = records.filter("user_id != ''").groupBy("user_id").agg(F.sort_array(F.collect_set("split")).alias("s"))
    sets = sets.filter(F.size("s") > 1)
    pairs = F.flatten(
        F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("users"))


def population_audit(positions: DataFrame) -> DataFrame:
    """Per-user concentration and history lengths of training positions (user_id, history_len)."""
    per_user = positions.groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("history_len") == 1, 1).otherwise(0)).alias("len1"),
        F.sum(F.when(F.col("history_len") <= 2, 1).otherwise(0)).alias("len2"),
        F.sum("history_len").alias("len"),
    )
    # The user distribution is kept as a histogram over counts, which is small and mergeable.
    hist = per_user.groupBy("n").agg(
        F.count("*").alias("users"), F.sum("len1").alias("len1"), F.sum("len2").alias("len2"), F.sum("len").alias("len")
    )
    totals = hist.agg(
        F.sum("users").alias("users"), F.sum(F.col("n") * F.col("users")).alias("positions"),
        F.max("n").alias("max_per_user"), F.expr("percentile(n, 0.5, users)").alias("median_per_user"),
        F.sum("len1").alias("len1"), F.sum("len2").alias("len2"), F.sum("len").alias("len"),
    )
    top = F.ceil(F.col("users") * 0.1)
    down = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = hist.select("n", "users", F.coalesce(F.sum("users").over(down), F.lit(0)).alias("before"))
    limit = totals.select(top.alias("t")).scalar()
    share = ranked.agg(
        F.sum(F.col("n") * F.greatest(F.lit(0), F.least(F.col("users"), limit - F.col("before")))).alias("s")
    )
    return totals.select(
        "users", "positions", (F.col("positions") / F.col("users")).alias("mean_per_user"), "median_per_user", "max_per_user",
        (share.scalar() / F.col("positions")).alias("top10_share"),
        (F.col("len1") / F.col("positions")).alias("share_len_1"),
        (F.col("len2") / F.col("positions")).alias("share_len_le_2"),
        (F.col("len") / F.col("positions")).alias("mean_history"),
    )
