"""Readers and writers of the record families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow import schemas
from winnow.operators.contracts import require_clean, sft_violations, table_violations, feedback_violations
from winnow.operators.history import strict_history
from winnow.sources.lines import bad_lines


def _read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    # A malformed line keeps its text in _corrupt, so that it can be reported rather than lost.
    return (
        spark.read.schema(f"{schema}, _corrupt string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )


def _require_parsed(df: DataFrame, path: str, schema: str) -> DataFrame:
    # Spark refuses a raw scan of the corrupt column alone, so one parsed column goes with it.
    bad = df.filter(F.col("_corrupt").isNotNull()).select("_corrupt", df.columns[0])
    if bad.first() is not None:
        # Only now is it worth a slower read that knows files and lines.
        for row in bad_lines(df.sparkSession, path, schema).orderBy("_file", "_line").limit(1).collect():
            raise ValueError(f"{row['_file']}:{row['_line']}: malformed line: {row['_error']}")
        require_clean(bad, f"{path}: malformed line")
    return df.drop("_corrupt")


def read_sft(spark: SparkSession, path: str, split: str | None = None, check: bool = True) -> DataFrame:
    """SFT records from JSON lines; a row of another split is an error, not a filter."""
    df = _require_parsed(_read_json(spark, path, schemas.SFT), path, schemas.SFT)
    df = df.withColumn("label_origin", F.coalesce("label_origin", F.lit("observed")))
    if check:
        require_clean(sft_violations(df), path)
        require_clean(table_violations(df), path)
        if split:
            require_clean(df.filter(F.col("split") != split).select("record_id", "split"), f"{path}: expected {split}")
    return df


def read_feedback(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    df = _require_parsed(_read_json(spark, path, schemas.FEEDBACK), path, schemas.FEEDBACK)
    if check:
        require_clean(feedback_violations(df), path)
    return df


def read_sid_split(spark: SparkSession, path: str, split: str, task: str | None = None) -> DataFrame:
    """Records of one split (and task); on a table partitioned by (task, split) others are not read."""
    if split not in schemas.SID_SPLITS:
        raise ValueError(f"split must be one of {schemas.SID_SPLITS}, not {split!r}")
    df = spark.read.parquet(path).filter(F.col("split") == split)
    return df if task is None else df.filter(F.col("task") == task)


def write_records(df: DataFrame, path: str, form: str = "json", partition_by: tuple[str, ...] = ()) -> None:
    """Write records; an existing output is never overwritten."""
    writer = df.write.mode("errorifexists").format(form)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def review_violations(raw: DataFrame) -> DataFrame:
    """Reviews without ids or with a timestamp that is not an integer >= 0, as (row, rule)."""
    from winnow.operators.contracts import rules

    return rules(
        raw.withColumn("row", F.to_json(F.struct("user_id", "parent_asin", "timestamp"))),
        "row",
        {
            "user_id": F.col("user_id").isNotNull(),
            "parent_asin": F.col("parent_asin").isNotNull(),
            "timestamp": F.coalesce(F.col("timestamp").cast("string").rlike("^[0-9]+$"), F.lit(False)),
        },
    )


def normalize_reviews(raw: DataFrame, domain: str | Column) -> DataFrame:
    """Review rows to events; the event id is a digest of domain, user, item and time."""
    from winnow.functions.keys import json_array, json_text

    dom = F.lit(domain) if isinstance(domain, str) else domain
    identity = json_array(json_text(dom), json_text("user_id"), json_text("parent_asin"), F.col("timestamp").cast("string"))
    return raw.select(
        F.sha2(identity, 256).alias("event_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("parent_asin").cast("string").alias("item_id"),
        F.col("timestamp").cast("bigint").alias("timestamp"),
        dom.alias("domain"),
        F.col("rating").cast("double").alias("rating"),
    )


def read_reviews(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """JSON lines, plain or gzip; fails on a missing id or a timestamp that is not an integer."""
    raw = _require_parsed(_read_json(spark, path, schemas.REVIEW), path, schemas.REVIEW)
    require_clean(review_violations(raw), path)
    return normalize_reviews(raw, domain)


def read_upstream_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').csv(path)


#: A quoted string of a list literal, and a whole literal of them.
QUOTED = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""
#: Most literals are strings in single quotes with nothing to undo and one blank between them: one split reads them.
PLAIN = r"""^\['[^'"\\]*+(?:', '[^'"\\]*+)*+'\]\z"""
LITERAL = rf"(?s)^\s*\[\s*(?:{QUOTED}(?:\s*,\s*{QUOTED})*\s*,?)?\s*\]\s*$"


def _replaced(old: Column, new: Column):
    return lambda s: F.replace(s, old, new)


def list_literal(column: str) -> Column:
    """The strings of a Python list literal in either kind of quotes; anything else, null included, is an error."""
    c = F.col(column)
    slash, mark = F.lit("\\"), F.lit("\u0000")  # the mark stands for an escaped backslash while the other escapes are undone
    bare = F.transform(
        F.regexp_extract_all(c, F.lit(rf"(?s){QUOTED}"), F.lit(0)),
        lambda q: F.replace(F.substring(q, F.lit(2), F.length(q) - 2), F.concat(slash, slash), mark))
    for escape, character in (("'", "'"), ('"', '"'), ("n", "\n"), ("t", "\t"), ("r", "\r")):
        bare = F.transform(bare, _replaced(F.concat(slash, F.lit(escape)), F.lit(character)))
    known = F.forall(bare, lambda s: ~F.contains(s, slash))
    plain = F.transform(bare, lambda s: F.replace(s, mark, slash))
    ok = F.coalesce(c.rlike(LITERAL) & known, F.lit(False))
    split = F.split(F.substring(c, F.lit(3), F.length(c) - 4), "', '", -1)
    return F.when(F.coalesce(c.rlike(PLAIN), F.lit(False)), split).when(ok, plain).otherwise(F.raise_error(F.concat(F.lit(f"{column}: not a list of strings: "), F.coalesce(c, F.lit("null")))))


def parse_history_column(df: DataFrame, column: str, h: int) -> DataFrame:
    """A Python list literal in a text column to its last h items; a text that is no such list raises."""
    from winnow.plans.ordered import last_items

    return df.withColumn("history", last_items(list_literal(column), h))


def unknown_items(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Items of a history or target that the catalog does not know: (item_id, uses). A null history is empty."""
    history = F.coalesce("history", F.array().cast("array<string>"))
    used = df.select(F.explode(F.concat(history, F.array("item_id"))).alias("item_id"))
    counted = used.groupBy("item_id").agg(F.count("*").alias("uses"))
    return counted.join(catalog.select("item_id").distinct(), "item_id", "left_anti")


def read_feedback_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(schemas.FEEDBACK_LOG).csv(path)


def known_label(column: str) -> Column:
    """Text label to double; the spellings of 'unknown' become null."""
    value = F.trim(F.coalesce(F.col(column), F.lit("")))
    # The spellings of an unknown label in the log.
    return F.when(~value.isin("", "-1", "nan", "None"), value.cast("double"))


def log_duplicates(log: DataFrame) -> DataFrame:
    keys = ["user_id", "video_id", "time_ms", "tab"]
    return log.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def feedback_log_to_records(log: DataFrame, train_end: float, selection_end: float, h: int = 20, tie: str | None = None) -> DataFrame:
    """Interaction log to multi-feedback records.

    A row without any known label is no record, but stays in later histories. `tie` orders equal
    times; without it the row's own columns do.
    """
    if not train_end < selection_end or h < 1:
        raise ValueError(f"training must end before selection and histories hold at least one item: {train_end}, {selection_end}, {h}")
    t = F.col("time_ms").cast("double")
    key = F.col(tie).cast("string") if tie else F.concat_ws("|", "video_id", "tab")
    events = log.select(
        "user_id", F.col("video_id").alias("item_id"), F.col("tab").alias("scene"), t.alias("timestamp"), key.alias("_tie"),
        F.array(known_label("is_click"), known_label("is_like")).alias("labels"),
    )
    past = strict_history(events, ["user_id"], "timestamp", F.struct("item_id", "timestamp"), h, ["_tie"])
    split = F.when(F.col("timestamp") < train_end, "train").when(F.col("timestamp") < selection_end, "selection").otherwise("test")
    rows = past.filter(F.exists("labels", lambda y: y.isNotNull()))
    return rows.select(
        F.sha2(F.to_json(F.struct("user_id", "item_id", "timestamp", "scene")), 256).alias("record_id"),
        "user_id",
        F.transform("history", lambda x: x["item_id"]).alias("history"),
        F.transform("history", lambda x: x["timestamp"]).alias("history_times"),
        "timestamp", "item_id", "scene", "labels", split.alias("split"),
        F.lit("").alias("prompt"), F.lit(None).cast("double").alias("propensity"), F.lit("log").alias("source"),
    )


def encode_records(df: DataFrame, encoder, check: bool = True) -> DataFrame:
    """Run a user's record encoder (pandas batches in, SFT batches out) and check what it yields."""
    out = df.mapInPandas(encoder, schemas.SFT)
    if check:
        require_clean(sft_violations(out), "encoder output")
        require_clean(table_violations(out), "encoder output")
    return out
