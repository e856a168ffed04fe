"""Structured Streaming forms of the operators that are incremental by nature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.keys import seeded
from winnow.operators.sampling import digest_cutoff
from winnow.plans.cut import cut
from winnow.sources.readers import normalize_reviews
from winnow.streaming.history_state import HistoryProcessor

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _sound() -> Column:
    known = F.col("user_id").isNotNull() & F.col("parent_asin").isNotNull()
    return known & F.coalesce(F.col("timestamp").rlike("^[0-9]+$"), F.lit(False))


def stream_normalize(raw: DataFrame, domain: str, delay: str = "10 minutes") -> DataFrame:
    """Review lines to events, each event id once within the watermark; run_normalize also keeps the rows it cannot take."""
    good = raw.filter(_sound())
    events = normalize_reviews(good, domain).withColumn("event_time", F.timestamp_seconds("timestamp"))
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


def rejected_reviews(raw: DataFrame) -> DataFrame:
    return raw.filter(~_sound())


def run_normalize(raw: DataFrame, domain: str, path: str, checkpoint: str, delay: str = "10 minutes") -> None:
    """Run both sides of the stream over what is there now: events to path/events, rejected rows to path/rejects."""
    run_available(stream_normalize(raw, domain, delay), f"{path}/events", f"{checkpoint}/events")
    run_available(rejected_reviews(raw), f"{path}/rejects", f"{checkpoint}/rejects")


def stream_mature(events: DataFrame, time: str, window_seconds: int, keep: list[str]) -> DataFrame:
    """Events whose feedback window has closed: emitted once the watermark passes time + window.

    The window is the watermark delay, so append mode holds each one-second group back until then.
    """
    return (
        events.withWatermark(time, f"{window_seconds} seconds")
        .groupBy(F.window(time, "1 second"), *keep)
        .agg(F.count("*").alias("copies"))
        .select(*keep, "copies")
    )


class Versions:
    """A small table kept by a foreachBatch function, one version a batch.

    A replayed batch reads the version before its own and rewrites its own only; older ones than the last two are
    removed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def numbers(self) -> list[int]:
        """Batches with a complete version; a missing folder has none, any other fault is raised."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(root):
            return []
        names = [f.getPath() for f in fs.listStatus(root)]
        done = [p.getName() for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n.removeprefix("batch=")) for n in done if n.startswith("batch="))

    def read(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/batch={number:012d}")

    def before(self, number: int | None = None) -> DataFrame | None:
        found = [n for n in self.numbers() if number is None or n < number]
        return self.read(found[-1]) if found else None

    def write(self, df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={number:012d}")
        jvm = self.spark._jvm
        for old in [n for n in self.numbers() if n < number][:-1]:
            place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={old:012d}")
            place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def stream_root_reservoir(state_path: str, root: str, k: int, seed: int):
    """A foreachBatch function that keeps the k roots with the smallest digest seen so far.

    The new state ends in one cutoff digest, found by counting, so no task sorts or holds the roots.
    """

    def update(batch: DataFrame, batch_id: int) -> None:
        state = Versions(batch.sparkSession, state_path)
        fresh = batch.select(F.col(root).cast("string").alias("root")).distinct().withColumn("h", seeded(seed, "root"))
        before = state.before(batch_id)
        merged = cut(fresh if before is None else fresh.unionByName(before).distinct())
        last = digest_cutoff(merged.select("h"), k)
        state.write(merged if last is None else merged.filter(F.col("h") <= F.lit(last)), batch_id)

    return update


def current_roots(spark: SparkSession, state_path: str) -> DataFrame | None:
    """The latest reservoir state; None before the first batch. A state that cannot be read is an error."""
    return Versions(spark, state_path).before()


def rolling_unit_window(path: str, window: str, keep: int):
    """A foreachBatch function whose state holds the rows of the newest `keep` windows seen so far, and no others."""

    def update(batch: DataFrame, batch_id: int) -> None:
        state = Versions(batch.sparkSession, path)
        before = state.before(batch_id)
        merged = cut(batch if before is None else batch.unionByName(before))
        state.write(last_windows(merged, window, keep), batch_id)

    return update


def current_units(spark: SparkSession, path: str) -> DataFrame | None:
    return Versions(spark, path).before()


def last_windows(units: DataFrame, window: str, keep: int) -> DataFrame:
    """Units of the newest `keep` windows: a cutoff on the window number, no sort of the units."""
    newest = units.select(window).distinct().orderBy(F.col(window).desc()).limit(keep)
    cutoff = newest.agg(F.min(window).alias("c")).select("c").scalar()
    return units.filter(F.col(window) >= cutoff)


def stream_strict_history(events: DataFrame, h: int, delay: str = "1 second") -> DataFrame:
    """Strict history per event on a stream; an instant is emitted when the watermark has passed it.

    events: (user_id, event_id, item_id, t in seconds, event_time). Rows later than the watermark are
    dropped by Spark and counted in the query's progress. Needs the RocksDB state store.
    """
    return (
        events.withWatermark("event_time", delay)
        .groupBy("user_id")
        .transformWithStateInPandas(
            statefulProcessor=HistoryProcessor(h),
            outputStructType="user_id string, event_id string, t bigint, history array<string>",
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now, into parquet."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_batches(stream: DataFrame, function, checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(function).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
