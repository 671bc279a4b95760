"""The registered queries of the text operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.sources.tables import read_table

from . import (
    conversations,
    decontaminate,
    fingerprint,
    jaccard_join,
    language,
    license_scan,
    packing,
    passages,
    quality,
    sharding,
    token_count,
    url_reputation,
    whitening,
)
from .oracle import license_sql, repair_sql, shard_sql, url_sql

#: (verdict, host, path) of op3.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


#: Shards of op12.
SHARDS = 40


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_neighbours(read_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(read_table(spark, sf_dir, "documents"), k=3, percent=90)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.grades_of_labels(read_table(spark, sf_dir, "labels")), grades=3)
    return quality.rate(docs, model)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), eos=1)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language.learn(docs.where(~held_out))
    found = language.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors, components=4)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]).cast("array<double>")
    rows = whitening.whiten(vectors, model).select(
        "vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("_place", "whitened"))
    return rows.select("vec_id", (F.col("_place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                       "whitened", F.get(shares, F.col("_place")).alias("explained"),
                       F.lit(float(model.identity_error)).alias("identity_error"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    named = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    return sharding.shard(named, SHARDS, carry=["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    _, _, report = conversations.repair(conversations.damaged(turns))
    return conversations.completed(report, turns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_decontamination, op2_fingerprints, op3_url_filter, op4_license_scan, op5_jaccard_join, op6_token_counts,
           op7_quality, op8_packing, op9_substring_dedup, op10_language_id, op11_whitening, op12_sharding,
           op13_conversation_repair)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": url_sql(URL_RULES), "op4_license_scan": license_sql(), "op12_sharding": shard_sql(SHARDS),
            "op13_conversation_repair": repair_sql()}
