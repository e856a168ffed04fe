"""Streaming forms, run over the event table as a stream that is there in full."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from winnow.plans.cut import checkpoint_folder
from winnow.session import tune
from winnow.streaming import ops as O
from workload import tables as T
from workload.registry import query


def _stream(spark, sf, name="events"):
    """A table as a stream, be it one file or a folder of part files.

    A pattern, not a path: Spark takes the path of a stream for a folder and refuses one that is a file.
    """
    schema = tune(spark).read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


@contextmanager
def _state_settings(spark):
    """RocksDB state with one partition per core: a stateful query keeps its partition count for life."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": O.STATE_STORE,
        "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism),
    }
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _folders(spark):
    base = f"{checkpoint_folder(spark)}/winnow/{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"


def _events(spark, sf):
    return _stream(spark, sf).select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("item_id"), F.col("event_type").alias("domain"),
        T.day("ts").alias("t"), "value",
    )


@query(
    "str_normalize",
    """select user_id, item_id, "timestamp" from (select distinct user_id, item_id, "timestamp" from ev)""",
    "ev",
)
def str_normalize(spark, sf):
    """Many events share user, item and day, hence one review id: they must come out once."""
    out, state = _folders(spark)
    raw = _events(spark, sf).select(
        "user_id", F.col("item_id").alias("parent_asin"), F.col("t").cast("string").alias("timestamp"), F.col("value").alias("rating")
    )
    with _state_settings(spark):
        O.run_normalize(raw, "retail", out, state, "40 days")
    return spark.read.parquet(f"{out}/events").select("user_id", "item_id", "timestamp")


@query("str_rejected", """select user_id, item_id from ev where domain = (select min(domain) from ev)""", "ev")
def str_rejected(spark, sf):
    """One kind of event gets a time that is no integer; exactly its rows are in the sink of rejects."""
    out, state = _folders(spark)
    events = _events(spark, sf)
    least = T.ev(spark, sf).agg(F.min("domain").alias("d")).first()["d"]
    raw = events.select(
        "user_id", F.col("item_id").alias("parent_asin"),
        F.when(F.col("domain") == least, F.concat(F.col("t").cast("string"), F.lit(".5"))).otherwise(F.col("t").cast("string")).alias("timestamp"),
        F.col("value").alias("rating"),
    )
    with _state_settings(spark):
        O.run_normalize(raw, "retail", out, state, "40 days")
    return spark.read.parquet(f"{out}/rejects").select("user_id", F.col("parent_asin").alias("item_id"))


@query(
    "str_mature",
    """select event_id, "timestamp" as t from ev where "timestamp" + 604800 < (select max("timestamp") from ev)""",
    "ev",
)
def str_mature(spark, sf):
    """Events older than a seven-day feedback window at the newest event."""
    out, state = _folders(spark)
    events = _events(spark, sf).withColumn("time", F.timestamp_seconds("t"))
    with _state_settings(spark):
        O.run_available(O.stream_mature(events, "time", 604800, ["event_id", "t"]), out, state)
    return spark.read.parquet(out).select("event_id", "t")


@query(
    "str_root_reservoir",
    """select distinct user_id as root from ev order by sha256('21|' || user_id) limit 40""",
    "ev",
)
def str_root_reservoir(spark, sf):
    out, state = _folders(spark)
    O.run_batches(_events(spark, sf), O.stream_root_reservoir(out, "user_id", 40, 21), state)
    return O.current_roots(spark, out).select("root")


@query(
    "str_strict_history",
    """select event_id, user_id, coalesce(array_to_string(list_transform(
           list_slice(list_filter(al, lambda x: x.t < e."timestamp"), -20, -1), lambda x: x.i), ','), '') as history
       from ev e join (select user_id, list({'t': "timestamp", 'e': event_id, 'i': item_id} order by "timestamp", event_id) as al from ev group by user_id) u
         using (user_id)
       where e."timestamp" < (select max("timestamp") from ev)""",
    "ev",
)
def str_strict_history(spark, sf):
    """The newest day stays open at the end of the stream; every earlier one is emitted."""
    out, state = _folders(spark)
    events = _events(spark, sf).select("user_id", "event_id", "item_id", "t").withColumn("event_time", F.timestamp_seconds("t"))
    with _state_settings(spark):
        O.run_available(O.stream_strict_history(events, 20, "1 hour"), out, state)
    return spark.read.parquet(out).select("event_id", "user_id", F.array_join("history", ",").alias("history"))


@query(
    "str_rolling_unit_window",
    """with u as (select "timestamp" as w, domain, avg(value) as f from ev group by all)
       select w, domain, round(f, 6) as feature from u where w in (select distinct w from u order by w desc limit 5)""",
    "ev",
)
def str_rolling_unit_window(spark, sf):
    out, state = _folders(spark)
    O.run_batches(_events(spark, sf), O.rolling_unit_window(out, "t", 5), state)
    units = O.current_units(spark, out).groupBy(F.col("t").alias("w"), "domain").agg(F.avg("value").alias("f"))
    return units.select("w", "domain", (F.round("f", 6) + F.lit(0.0)).alias("feature"))
