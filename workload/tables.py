"""The driver's tables in the shapes the operators take, the counterpart of workload.views."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.keys import stable_bucket
from winnow.functions.vectors import sum_by
from winnow.operators.contracts import record_keys
from winnow.operators.history import task_rows, with_history
from winnow.plans.cut import cut
from winnow.session import tune

TRAIN_END, SELECT_END = 946684800, 978307200  # 2000-01-01 and 2001-01-01, for purchases
EVENT_TRAIN_END, EVENT_SELECT_END = 1705795200, 1706227200  # 2024-01-21 and 2024-01-26, for events
D = 64  # width of the embeddings


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of a single small file is read by one task; share its rows out before heavy row work.

    A large table already has more read tasks than cores and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def day(column: str) -> Column:
    return F.unix_date(F.to_date(column)).cast("bigint") * F.lit(86400).cast("bigint")


def ev(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "events")).select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("item_id"), F.col("event_type").alias("domain"),
        day("ts").alias("timestamp"), "value",
    )


def _buy(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases under a binary digest, half as long as its text: one shuffle by order both drops copies and meets the orders."""

    def cents(c: str) -> Column:
        return F.round(F.col(c) * 100).cast("bigint")

    lines = spread(table(spark, sf, "lineitem")).filter("l_orderkey is not null").select(
        "l_orderkey", "l_partkey",
        F.unhex(F.sha2(
            F.concat_ws(
                "|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents("l_quantity"), cents("l_extendedprice"),
                cents("l_discount"), cents("l_tax"), "l_returnflag", "l_linestatus", day("l_shipdate"),
            ),
            256,
        )).alias("event_id"),
    ).repartition("l_orderkey").dropDuplicates(["l_orderkey", "event_id"])
    return _bought(spark, sf, lines, "event_id", F.col("l_partkey").cast("string").alias("item_id"))


def _bought(spark: SparkSession, sf: str, lines: DataFrame, *columns) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", day("o_orderdate").alias("timestamp"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        *columns[:1], F.col("o_custkey").cast("string").alias("user_id"), *columns[1:], F.lit("retail").alias("domain"), "timestamp",
    )


def _buyers(spark: SparkSession, sf: str) -> DataFrame:
    """(domain, user_id) of every purchase and its copies, which is cheaper than the purchases and enough to find hot users."""
    return _bought(spark, sf, table(spark, sf, "lineitem").select("l_orderkey")).select("domain", "user_id")


def _text_id(df: DataFrame) -> DataFrame:
    return df.withColumn("event_id", F.lower(F.hex("event_id")))


def buy(spark: SparkSession, sf: str) -> DataFrame:
    return _text_id(_buy(spark, sf))


def cat(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.lit("retail").alias("domain"), F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("title"),
        F.col("p_type").alias("category"),
        F.when(F.col("p_size") <= 40, F.concat(F.lit("P"), F.col("p_partkey").cast("string"))).alias("answer"),
        F.col("p_brand").alias("brand"), F.col("p_size").alias("size"),
    )


def hist(spark: SparkSession, sf: str) -> DataFrame:
    # Digests sort as their texts do.
    return _text_id(with_history(_buy(spark, sf), 20, _buyers(spark, sf)))


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    return _text_id(task_rows(_buy(spark, sf), cat(spark, sf), 20, _buyers(spark, sf)))


def ehist(spark: SparkSession, sf: str) -> DataFrame:
    return with_history(cut(ev(spark, sf)), 20)


def items(column: str = "history") -> Column:
    return F.transform(column, lambda x: x["item_id"])


def turns(spark: SparkSession, sf: str) -> DataFrame:
    conv = table(spark, sf, "conversations")
    asked = conv.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    said = conv.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return asked.join(said, ["conv_id", "turn"], "left")


def token_ids(text: Column) -> Column:
    return F.transform(F.split(text, " "), lambda w: stable_bucket(w, 32000).cast("int"))


def encoded(spark: SparkSession, sf: str) -> DataFrame:
    root = F.col("conv_id").cast("string")
    b = stable_bucket(root, 1000)
    split = (
        F.when(b < 700, "train").when(b < 800, "select").when(b < 900, "tune").when(b < 950, "audit").otherwise("holdout")
    )
    return turns(spark, sf).select(
        F.concat(root, F.lit(":"), F.col("turn").cast("string")).alias("record_id"), root.alias("root_id"),
        F.lit("chat").alias("task"), F.when(F.col("turn") == 0, "opening").otherwise("followup").alias("domain"),
        F.lit("conversations").alias("source"), split.alias("split"), token_ids(F.col("prompt")).alias("prompt_ids"),
        F.when(F.col("response").isNull(), F.array().cast("array<int>")).otherwise(token_ids(F.col("response"))).alias("response_ids"),
        F.lit("words-32000").alias("recipe_id"),
        F.concat(F.lit("u"), stable_bucket(F.concat(F.lit("user"), root), 50).cast("string")).alias("user_id"),
        F.lit("observed").alias("label_origin"),
    )


def sft_all(spark: SparkSession, sf: str) -> DataFrame:
    from winnow.operators.history import assemble_supervision

    ids, labels = assemble_supervision(F.col("prompt_ids"), F.col("response_ids"), 1 << 30)
    return encoded(spark, sf).withColumn("input_ids", ids).withColumn("labels", labels).drop("prompt_ids", "response_ids")


def sft_keyed(spark: SparkSession, sf: str) -> DataFrame:
    """All records with their keys."""
    return record_keys(sft_all(spark, sf))


def sft(spark: SparkSession, sf: str) -> DataFrame:
    """The records that are valid, for operators that need valid ones."""
    rows = sft_keyed(spark, sf)
    return rows.filter((F.col("cost") > 0) & (F.size("input_ids") >= 2) & (F.col("split") != "holdout"))


def vec(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label",
        F.col("label").cast("string").alias("cell"),
        F.floor(F.col("vec_id") / 5).cast("string").alias("grp"),
        (F.col("vec_id") % 7 + 1).cast("bigint").alias("cost"),
    )


def targets(spark: SparkSession, sf: str) -> list[list[float]]:
    """The three target vectors: three label centroids less the global one (driver-sized)."""
    sums = {r["label"]: (np.asarray(r["s"]), r["w"]) for r in sum_by(vec(spark, sf), ["label"], "v").collect()}  # one row per label
    overall = sum(s for s, _ in sums.values()) / sum(w for _, w in sums.values())
    return [(sums[k][0] / sums[k][1] - overall).tolist() for k in range(3)]


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """id, label, cost, cell, grp and the three responses in one array."""
    from winnow.operators.frontier import response_matrix

    return response_matrix(vec(spark, sf), "v", targets(spark, sf))


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    known = table(spark, sf, "labels")
    return docs.join(known, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("scene"),
        F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"),
        F.col("n_chars").cast("double").alias("n_chars"),
    )


def action_shares(spark: SparkSession, sf: str) -> DataFrame:
    """One row per event type: its index in name order and its share of the log."""
    from pyspark.sql import Window

    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    # A window over the handful of action names, not over the log.
    return counts.select("event_type", F.row_number().over(Window.orderBy("event_type")).alias("action"), (F.col("n") / total).alias("e"))


def bandit(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select("event_id", "event_type", (F.col("value") / 500.0).alias("reward"))
    return log.join(action_shares(spark, sf), "event_type").drop("event_type")
