"""Record contracts: derived keys, violations, leaks, fingerprints and plan audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.keys import json_array, json_text
from winnow.schemas import FEEDBACK_SPLITS, MASKED, SFT_SPLITS


def rules(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """One row per broken rule; a check that is null counts as broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    found = F.filter(F.array(*broken), lambda x: x.isNotNull())
    return df.select(F.col(key), F.explode(found).alias("rule"))


def require_clean(violations: DataFrame, what: str) -> None:
    """Raise when a violations table has a row."""
    first = violations.limit(1).collect()
    if first:
        raise ValueError(f"{what}: {first[0].asDict()}")


def response_cost(labels: Column | str) -> Column:
    """Supervised tokens after the first position."""
    arr = F.col(labels) if isinstance(labels, str) else labels
    tail = F.slice(arr, F.lit(2), F.greatest(F.size(arr) - 1, F.lit(0)))
    return F.size(F.filter(tail, lambda x: x != MASKED)).cast("bigint")


def record_keys(df: DataFrame) -> DataFrame:
    """Add cost, cell, content_id and provenance_group."""
    return (
        df.withColumn("cost", response_cost("labels"))
        .withColumn("cell", F.to_json(F.array("task", "domain")))
        .withColumn(
            "content_id",
            F.sha2(json_array(F.to_json("input_ids"), F.to_json("labels"), json_text("recipe_id")), 256),
        )
        .withColumn("provenance_group", F.sha2(F.to_json(F.array("root_id", "task", "domain")), 256))
    )


def sft_violations(df: DataFrame) -> DataFrame:
    """Broken record rules as (record_id, rule)."""
    ids, labels = F.col("input_ids"), F.col("labels")
    filled = F.lit(True)
    for name in ("record_id", "root_id", "task", "domain", "source", "recipe_id", "label_origin"):
        filled = filled & F.coalesce(F.length(F.trim(F.col(name))) > 0, F.lit(False))
    same_length = F.size(ids) == F.size(labels)
    allowed = F.forall(F.zip_with(ids, labels, lambda x, y: (y == MASKED) | (y == x)), lambda ok: F.coalesce(ok, F.lit(False)))
    return rules(
        df,
        "record_id",
        {
            "empty_string": filled,
            "split": F.col("split").isin(*SFT_SPLITS),
            "user_id": F.col("user_id").isNull() | (F.col("user_id") != ""),
            "length": (F.size(ids) >= 2) & same_length,
            "token": F.forall(ids, lambda x: F.coalesce(x >= 0, F.lit(False))),
            "label": allowed,
            "first_label": F.try_element_at(labels, F.lit(1)) == MASKED,
            "cost": response_cost("labels") > 0,
        },
    )


def table_violations(df: DataFrame) -> DataFrame:
    """Duplicate record ids, more than one recipe, or no rows, as (rule, key, n)."""
    repeated = (
        df.groupBy(F.col("record_id").alias("key"))
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.lit("duplicate_record_id").alias("rule"), "key", "n")
    )
    # One aggregate over the few distinct recipes answers both remaining rules.
    recipes = df.groupBy("recipe_id").agg(F.count("*").alias("rows"))
    overall = recipes.agg(F.count("*").alias("recipes"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    mixed = overall.filter("recipes > 1").select(
        F.lit("mixed_recipe").alias("rule"), F.lit("").alias("key"), F.col("recipes").alias("n")
    )
    empty = overall.filter("rows = 0").select(
        F.lit("empty_table").alias("rule"), F.lit("").alias("key"), F.lit(0).cast("bigint").alias("n")
    )
    return repeated.unionByName(mixed).unionByName(empty)


def partition_leaks(df: DataFrame) -> DataFrame:
    """Keys seen in more than one split: (kind, key, splits).

    Records, roots and exact contents may not cross any splits. Users may be shared between train
    and an evaluation split, but not between evaluation splits. The recipe must be the same.
    """
    user = F.when((F.col("split") != "train") & (F.col("user_id") != ""), F.col("user_id"))
    kinds = F.array(
        F.struct(F.lit("record").alias("kind"), F.col("record_id").alias("key")),
        F.struct(F.lit("root").alias("kind"), F.col("root_id").alias("key")),
        F.struct(F.lit("content").alias("kind"), F.col("content_id").alias("key")),
        F.struct(F.lit("user").alias("kind"), user.alias("key")),
    )
    keys = df.select("split", F.explode(kinds).alias("k")).select("k.kind", "k.key", "split").filter("key is not null")
    # At most five splits per key, so the set stays tiny and is combined map-side.
    crossed = (
        keys.groupBy("kind", "key")
        .agg(F.array_join(F.sort_array(F.collect_set("split")), ",").alias("splits"), F.countDistinct("split").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    recipe = (
        df.groupBy("recipe_id", "split").agg(F.count("*").alias("_n"))
        .groupBy("recipe_id").agg(F.array_join(F.sort_array(F.collect_set("split")), ",").alias("splits"))
    )
    several = recipe.agg(F.count("*").alias("n"))
    mixed = recipe.filter(several.select("n").scalar() > 1).select(
        F.lit("recipe").alias("kind"), F.col("recipe_id").alias("key"), "splits"
    )
    return crossed.unionByName(mixed)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, lane_a, lane_b): an identity of the pool that does not depend on row order."""
    row = F.sha2(F.concat_ws("|", "record_id", "root_id", "cell", "split", "content_id"), 256)
    lanes = [F.conv(F.substring(row, start, 12), 16, 10).cast("decimal(20,0)") for start in (1, 13)]
    modulus = F.lit(2**48).cast("decimal(20,0)")
    return df.select(lanes[0].alias("a"), lanes[1].alias("b")).agg(
        F.count("*").alias("rows"),
        (F.coalesce(F.sum("a"), F.lit(0)) % modulus).cast("bigint").alias("lane_a"),
        (F.coalesce(F.sum("b"), F.lit(0)) % modulus).cast("bigint").alias("lane_b"),
    )


def require_same_pool(left: DataFrame, right: DataFrame) -> None:
    """Refuse to mix artifacts of two pools."""
    if table_fingerprint(left).first() != table_fingerprint(right).first():
        raise ValueError("artifacts belong to different pools")


def feedback_violations(df: DataFrame) -> DataFrame:
    """Broken multi-feedback rules as (record_id, rule)."""
    times, labels = F.col("history_times"), F.col("labels")

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    strict = F.forall(times, lambda t: finite(t) & (t < F.col("timestamp")))
    named = F.lit(True)
    for name in ("record_id", "user_id", "item_id"):
        named = named & (F.length(F.col(name)) > 0)
    return rules(
        df,
        "record_id",
        {
            "split": F.col("split").isin(*FEEDBACK_SPLITS),
            "identifier": named,
            "timestamp": finite(F.col("timestamp")),
            "history_length": F.size("history") == F.size("history_times"),
            "strict_history": strict,
            "sorted_history": F.array_sort(times) == times,
            "observed_label": F.exists(labels, lambda y: y.isNotNull()),
            "label_range": F.forall(labels, lambda y: y.isNull() | (finite(y) & (y >= 0) & (y <= 1))),
            "propensity": F.col("propensity").isNull()
            | (finite(F.col("propensity")) & (F.col("propensity") > 0) & (F.col("propensity") <= 1)),
        },
    )


def split_boundary_report(df: DataFrame, splits: Sequence[str] = FEEDBACK_SPLITS) -> DataFrame:
    """(rule, a, b): label widths that differ, missing splits, and splits that overlap in time."""
    spans = df.groupBy("split").agg(
        F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"),
        F.min(F.size("labels")).alias("wlo"), F.max(F.size("labels")).alias("whi"),
    )
    # One row with every split's span, so that the pair rules are plain expressions.
    row = spans.agg(
        F.min("wlo").alias("wlo"), F.max("whi").alias("whi"),
        *[F.min(F.when(F.col("split") == s, F.col("lo"))).alias(f"lo_{s}") for s in splits],
        *[F.max(F.when(F.col("split") == s, F.col("hi"))).alias(f"hi_{s}") for s in splits],
    )
    found = [F.when(F.col("wlo") != F.col("whi"), _rule("label_width", "", ""))]
    for i, a in enumerate(splits):
        found.append(F.when(F.col(f"lo_{a}").isNull(), _rule("missing_split", a, "")))
        for b in splits[i + 1:]:
            found.append(F.when(F.col(f"hi_{a}") >= F.col(f"lo_{b}"), _rule("overlap", a, b)))
    return row.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("r")).select("r.*")


def _rule(rule: str, a: str, b: str) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(a).alias("a"), F.lit(b).alias("b"))


def plan_audit(plan: DataFrame, records: DataFrame) -> DataFrame:
    """(occurrence_id, rule) for plan rows that disagree with the records they name."""
    known = records.select(
        F.col("record_id").alias("r_id"), F.col("cost").alias("r_cost"), F.size("input_ids").alias("r_len"),
        F.col("cell").alias("r_cell"), F.col("content_id").alias("r_content"), F.col("split").alias("r_split"),
    )
    rows = plan.join(known, plan["record_id"] == known["r_id"], "left")
    found = rules(
        rows,
        "occurrence_id",
        {
            "unknown_record": F.col("r_id").isNotNull(),
            "response_tokens": F.col("r_id").isNull() | (F.col("response_tokens") == F.col("r_cost")),
            "input_tokens": F.col("r_id").isNull() | (F.col("input_tokens") == F.col("r_len")),
            "cell": F.col("r_id").isNull() | (F.col("cell") == F.col("r_cell")),
            "content": F.col("r_id").isNull() | (F.col("content_id") == F.col("r_content")),
            "not_train": F.col("r_id").isNull() | (F.col("r_split") == "train"),
            "empty_occurrence": F.length("occurrence_id") > 0,
        },
    )
    repeated = (
        plan.groupBy("occurrence_id").agg(F.count("*").alias("_n")).filter("_n > 1")
        .select("occurrence_id", F.lit("duplicate_occurrence").alias("rule"))
    )
    return found.unionByName(repeated)
