"""The registered queries of this package, with SQL where SQL can state the result."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import bytepair, chattree, hamming, language, lattice, minhash, multiindex, packing, personal, subcodes, tokenalign, toxicity, urls
from winnow.llm.common import documents

QUERIES = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates on three-word shingles at 0.85."""
    return minhash.near_duplicates(documents(spark, sf_dir), k=3, num=85, den=100)


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = documents(spark, sf_dir)
    return language.predict(docs, language.train(docs))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, documents(spark, sf_dir, "labels")))


@query
def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's URL."""
    return urls.judge(documents(spark, sf_dir, "pages"))


@query
def op5_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = documents(spark, sf_dir)
    return personal.find(docs, personal.train(docs))


@query
def op7_bytepair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bytepair.decode(bytepair.encode(documents(spark, sf_dir), path), path)
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    rows = packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every row whose vec_id is divisible by 100."""
    return hamming.nearest(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of a label at cosine 0.98."""
    return multiindex.near_duplicates(documents(spark, sf_dir, "embeddings"))


@query
def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every document."""
    return lattice.score(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_subcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors from four codebooks fitted in four exact rounds."""
    coded, codebooks = subcodes.fit(documents(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(subcodes.spell_codebooks(codebooks).encode()).hexdigest()
    return subcodes.label_errors(coded).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _subcodes_sql(rounds: int = 4) -> str:
    """The rounds written out one after another; k is a part's distance and entry in one number, the least of which is the choice."""
    steps = [
        """v AS (SELECT vec_id, label, [floor(1024 * e::DOUBLE) FOR e IN embedding] AS x FROM embeddings
          WHERE embedding IS NOT NULL AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0)""",
        """p AS MATERIALIZED (SELECT vec_id, label, part, x[part * len(x) // 4 + 1 : (part + 1) * len(x) // 4] AS x FROM v, range(4) AS r(part))""",
        """c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < 256)""",
    ]
    for t in range(rounds + 1):
        steps.append(
            f"""a{t} AS MATERIALIZED (SELECT vec_id, label, part, any_value(x) AS x,
              min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT * 256 + entry) AS k
              FROM p JOIN c{t} USING (part) GROUP BY vec_id, label, part)""")
        if t < rounds:
            steps.append(
                f"""m{t} AS (SELECT part, entry, list(m ORDER BY i) AS m FROM (SELECT part, k % 256 AS entry, i, floor(sum(x[i]) / count(*)) AS m
                  FROM (SELECT part, k, x, unnest(range(1, len(x) + 1)) AS i FROM a{t}) GROUP BY ALL) GROUP BY ALL),
                c{t + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, c) AS c FROM c{t} LEFT JOIN m{t} USING (part, entry))""")
    return f"""WITH {", ".join(steps)},
      codes AS (SELECT vec_id, label, string_agg(format('{{:02x}}', k % 256), '' ORDER BY part) AS code, sum(k // 256)::BIGINT AS error
        FROM a{rounds} GROUP BY vec_id, label)
      SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
        (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, i))
          FROM (SELECT part, entry, unnest(c) AS x, unnest(range(len(c))) AS i FROM c{rounds})) AS codebooks_sha256
      FROM codes"""


SQL["op11_subcodes"] = _subcodes_sql()


@query
def op12_tokenalign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers' tokens of every document overlap, with corpus counts of their links."""
    rows = tokenalign.align(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    slim = rows.withColumn("groups_sha256", F.when(F.col("pairs").isNull(), digest)).drop("groups")
    return tokenalign.with_counts(slim)


@query
def op13_chattree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that spells the marks, merged into prefix trees and read back from them."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = documents(spark, sf_dir, "conversations")
    told = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, "assistant", told)], "conv_id bigint, turn bigint, role string, text string")
    both = rows.select("conv_id", "turn", "role", "text").unionByName(extra)
    return chattree.read_back(chattree.grow(both, path), path)
