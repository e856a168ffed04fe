"""Item codes: namespacing, collision repair, legal code layouts and catalog distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.plans.ordered import with_group, with_row_number

# Codebook size and the letters of the four code levels.
CODES = 256
LEVELS = ("a", "b", "c", "d")
BAND = 64.0  # logits of a band differ by less


def sid_text(codes: Sequence[Column], offset: Column) -> Column:
    body = [F.format_string(f"<s_{level}_%d>", (c + offset).cast("int")) for level, c in zip(LEVELS, codes)]
    return F.concat(F.lit("<|sid_begin|>"), *body, F.lit("<|sid_end|>"))


def namespace_catalog(index: DataFrame, domain_index: Column | int) -> DataFrame:
    """Add suffix, collision flag and sid to items (item_id, c1, c2, c3).

    Items that share a three-code prefix are numbered by item id; codes are offset by 256 per domain.
    """
    rows = index.withColumn("_domain", F.lit(domain_index) if isinstance(domain_index, int) else domain_index)
    numbered = with_row_number(rows, ["_domain", "c1", "c2", "c3"], [F.col("item_id")], "_rn")
    numbered = numbered.withColumn("suffix", F.col("_rn") - 1)
    offset = F.col("_domain") * CODES
    codes = [F.col("c1"), F.col("c2"), F.col("c3"), F.col("suffix")]
    return (
        numbered.withColumn("sid", sid_text(codes, offset))
        .withColumn("collision", F.col("suffix") > 0)
        .withColumn("exhausted", F.col("suffix") >= CODES)
        .drop("_rn", "_domain")
    )


def repair_collisions(catalog: DataFrame) -> DataFrame:
    """(item_id, old_code, new_code) for items whose four codes are already taken.

    The smallest item id keeps a duplicated code. The others take the free fourth codes of their
    prefix in (code, item id) order; new_code is null when the prefix has none left.
    """
    prefix = ["c1", "c2", "c3"]
    numbered = with_row_number(catalog, [*prefix, "c4"], [F.col("item_id")], "_dup").filter("_dup > 1")
    order = with_row_number(numbered, prefix, [F.col("c4"), F.col("item_id")], "_rank")
    # At most 256 distinct codes per prefix, whatever the number of items.
    free = catalog.groupBy(*prefix).agg(
        F.array_except(F.sequence(F.lit(0), F.lit(CODES - 1)), F.collect_set(F.col("c4").cast("int"))).alias("_free")
    )
    return order.join(free, prefix).select(
        "item_id", F.col("c4").alias("old_code"), F.try_element_at("_free", F.col("_rank").cast("int")).alias("new_code")
    )


def catalog_violations(catalog: DataFrame, width: int | None = None, eos: int = -1) -> DataFrame:
    """(key, rule) for duplicate, empty, EOS-carrying or wrongly sized code sequences."""
    key = F.array_join(F.col("codes").cast("array<string>"), ",")
    rows = catalog.select("item_id", "codes", key.alias("_seq"))
    repeated = (
        rows.groupBy("_seq").agg(F.count("*").alias("_n")).filter("_n > 1")
        .select(F.col("_seq").alias("key"), F.lit("duplicate_sequence").alias("rule"))
    )
    rules = [
        F.when(F.size("codes") == 0, F.lit("empty_sequence")),
        F.when(F.array_contains("codes", eos), F.lit("eos_inside")),
    ]
    if width is not None:
        rules.append(F.when(F.size("codes") != width, F.lit("code_count")))
    found = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return rows.select(F.col("item_id").alias("key"), F.explode(found).alias("rule")).unionByName(repeated)


def prefix_steps(catalog: DataFrame, eos: int | None = -1) -> DataFrame:
    """One row per item and decision: (..., depth, prefix, token)."""
    path = F.col("codes") if eos is None else F.concat("codes", F.array(F.lit(eos).cast("int")))
    rows = catalog.withColumn("_path", path)
    return (
        rows.select("*", F.posexplode("_path").alias("depth", "token"))
        .withColumn("prefix", F.slice("_path", F.lit(1), F.col("depth")))
        .drop("_path")
    )


def trie_next_distribution(catalog: DataFrame, p: str = "q", eos: int = -1) -> DataFrame:
    """(prefix, token, mass, prob): the conditional next-token law of a distribution over items.

    The mass of a (prefix, token) edge is summed map-side; the prefix total comes from the much
    smaller edge table, not from the items below the prefix.
    """
    edges = prefix_steps(catalog, eos).groupBy("prefix", "token").agg(F.sum(p).alias("mass"))
    total = with_group(edges, ["prefix"], F.sum("mass").alias("_total"))
    return total.filter("_total > 0 and mass > 0").withColumn("prob", F.col("mass") / F.col("_total")).drop("_total")


def item_path_probability(catalog: DataFrame, p: str = "q", eos: int = -1) -> DataFrame:
    """(item_id, path_probability): the product of the conditionals along each item's path."""
    law = trie_next_distribution(catalog, p, eos).select("prefix", "token", "prob")
    steps = prefix_steps(catalog, eos).select("item_id", "prefix", "token")
    rows = steps.join(law, ["prefix", "token"], "left")
    return rows.groupBy("item_id").agg(
        F.when(F.count("*") == F.count("prob"), F.exp(F.sum(F.log("prob")))).otherwise(0.0).alias("path_probability")
    )


def legal_layout(catalog: DataFrame) -> DataFrame:
    """(domain, item_id, depth, code, allowed, label): legal codes at each prefix, true code's index."""
    steps = prefix_steps(catalog, None).withColumnRenamed("token", "code")
    allowed = steps.groupBy("domain", "depth", "prefix").agg(F.sort_array(F.collect_set("code")).alias("allowed"))
    rows = steps.select("domain", "item_id", "depth", "prefix", "code")
    return rows.join(allowed, ["domain", "depth", "prefix"]).select(
        "domain", "item_id", "depth", "code", "allowed",
        (F.array_position("allowed", F.col("code")) - 1).alias("label"),
    )


def restricted_logprob(logits: DataFrame, layout: DataFrame, key: Sequence[str]) -> DataFrame:
    """Log probability of each record's item with the softmax over legal codes only.

    logits: (key..., domain, item_id, depth, code, logit). Codes outside `allowed` never enter the
    normaliser. Returns (key..., logprob, loss).

    Logits are many times the layout's rows. They stream past the layout of their partition and are summed there, unsorted; they
    are shuffled once, or not at all if both tables come dealt by domain, item and depth into equally many partitions.
    """
    step = ["domain", "item_id", "depth"]
    sides = layout.select(*step, "allowed", F.col("code").alias("_true"))
    rows = logits.join(sides.hint("shuffle_hash"), step).filter(F.array_contains("allowed", F.col("code")))
    # Exponentials are summed relative to the logit's band of 64, which cannot overflow; a record has few bands at a depth.
    band = F.floor(F.col("logit") / BAND).cast("double")
    sums = rows.groupBy(*dict.fromkeys([*key, *step]), band.alias("_band")).agg(
        F.sum(F.exp(F.col("logit") - band * BAND)).alias("_mass"), F.sum(F.when(F.col("code") == F.col("_true"), F.col("logit"))).alias("_own")
    )
    met = sums.repartition(*key).groupBy(*key, "depth").agg(F.collect_list(F.struct("_band", "_mass")).alias("_z"), F.sum("_own").alias("_own"))
    met = met.withColumn("_top", F.array_max(F.transform("_z", lambda x: x["_band"])))
    mass = F.aggregate("_z", F.lit(0.0), lambda s, x: s + F.coalesce(x["_mass"] * F.exp((x["_band"] - F.col("_top")) * BAND), F.lit(0.0)))
    # all legal codes are masked, or one is infinite
    total = F.when((mass == 0) | (mass == float("inf")), F.lit(float("nan"))).otherwise(F.col("_top") * BAND + F.log(mass))
    steps = met.select(*key, (F.col("_own") - total).alias("step"))
    return steps.groupBy(*key).agg(F.sum("step").alias("logprob"), (-F.avg("step")).alias("loss"))
