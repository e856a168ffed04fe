"""URL filter: host and path rules, and gradient-boosted trees on lexical features for what no rule fits.

Only DataFrame functions and the JVM's tree ensembles run here. The trees learn from the URLs that a rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import cut, prepare

#: The rules, as verdict and host with path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
SAMPLE = 20_000  # labelled URLs fitted on, taken in the order of a hash of the URL
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "parameters", "marks", "suffix_rows", "suffix_block"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ://."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, form, 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.coalesce(F.regexp_extract(url, form, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of two alike the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, part, ""))).cast("double")


def lexical(pages: DataFrame) -> DataFrame:
    """Add the features of url, host and path; a null URL has those of the empty text."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda sum_, c: sum_ - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    return (
        pages.withColumn("length", F.length(url).cast("double")).withColumn("host_length", F.length("host").cast("double"))
        .withColumn("path_length", F.length("path").cast("double")).withColumn("depth", _count(F.col("path"), "[^/]"))
        .withColumn("depth", F.col("path_length") - F.col("depth"))
        .withColumn("labels", F.when(F.col("host") == "", 0.0).otherwise(1.0 + F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))))
        .withColumn("digits", _count(url, "[0-9]") / size).withColumn("entropy", entropy)
        .withColumn("parameters", F.when(url.contains("?"), 1.0 + F.length(url) - F.length(F.replace(url, F.lit("&"), F.lit("")))).otherwise(0.0))
        .withColumn("marks", _count(url, "[-_~%#]")).withColumn("suffix", F.substring_index("host", ".", -1))
    )


def _suffixes(pages: DataFrame, weight: float = 10.0) -> DataFrame:
    """Log row count and share of blocked rows among the decided ones, for every suffix, drawn to the share of all by `weight` rows."""
    counts = cut(pages.groupBy("suffix").agg(
        F.count(F.lit(1)).alias("n"), F.count("verdict").alias("decided"), F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked")))
    blocked, decided = counts.agg(F.sum("blocked"), F.sum("decided")).first()
    prior = (blocked or 0) / decided if decided else 0.0
    return counts.select(
        "suffix", F.log1p("n").alias("suffix_rows"), ((F.col("blocked") + weight * prior) / (F.col("decided") + weight)).alias("suffix_block"))


def train(featured: DataFrame, sample: int = SAMPLE, trees: int = 10, depth: int = 4) -> GBTClassificationModel | None:
    """Boosted trees on up to `sample` decided URLs (1: block); none if no URL is decided."""
    chosen = cut(featured.where("verdict is not null").select(
        *FEATURES, (F.col("verdict") == "block").cast("double").alias("label"), F.xxhash64("url").alias("order"), "url").orderBy("order", "url").limit(sample))
    if chosen.isEmpty():
        return None
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(chosen).select("features", "label")
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=5).fit(rows)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, and decided_by (rule or trees).

    The longest fitting rule decides; otherwise the trees do. Null and malformed URLs have an empty host and path, fit no
    rule and go to the trees. Where no URL of the table is decided by a rule, everything else is allowed. Repeated rows get equal
    verdicts, null ids are kept, a very long URL is read whole, and an empty table gives no rows. Only the two named columns are read,
    so that no other name can clash.
    """
    prepare(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumn("host", host).withColumn("path", path)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = lexical(rows.withColumn("rule", rule).withColumn("verdict", verdict))
    featured = rows.join(_suffixes(rows), "suffix")
    model = train(featured)
    by = F.when(F.isnotnull("verdict"), "rule").otherwise("trees").alias("decided_by")
    if model is None:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), by)
    judged = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured))
    own = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), by)
