"""A corpus pipeline: rate, deduplicate, cut repeats, decontaminate, pack.

``STAGES`` lists the stages. Each takes (spark, docs, sf_dir) and returns a
DataFrame; the next one reads what it returned back from Parquet. All but the
last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import decontaminate, jaccard_join, packing, passages, quality
from tillroll.llm.queries import vocabulary
from tillroll.llm.runtime import prepare, saved
from tillroll.sources.tables import read_table

#: Near-duplicate stages: five-word shingles, similarity 0.8.
SHINGLE, PERCENT = 5, 80


def rate_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of the highest grade is too low."""
    model = quality.fit(docs, quality.grades_of_labels(read_table(spark, sf_dir, "labels")), grades=3)
    judge = quality.grade_of(spark, model)
    return docs.where(judge(F.col("text"))["tail"] >= quality.LEAST_TAIL)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the least id stays;
    of its rows that are equal or near copies of each other the one with the
    least text hash stays. Rows with a null id stay."""
    found = jaccard_join.similar_components(docs, k=SHINGLE, percent=PERCENT)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")
    several = saved(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_several")).count().where("count > 1"))
    if not several.head(1):
        return left
    again = F.col("doc_id") == F.col("_several")
    rows = saved(left.join(several, again, "left_semi").withColumn("_row", F.monotonically_increasing_id()))
    parts = (jaccard_join.similar_components(rows.select(F.col("_row").alias("doc_id"), "text"), k=SHINGLE, percent=PERCENT)
             .select(F.col("doc_id").alias("_part_row"), "n_shingles", "component_id"))
    # Texts without words are no copies of each other unless they are equal.
    group = ["doc_id", F.when(F.col("n_shingles") > 0, F.col("component_id")), F.when(F.col("n_shingles") == 0, F.struct("text"))]
    kept = (rows.join(parts, F.col("_row") == F.col("_part_row")).groupBy(*group)
            .agg(F.min(F.struct(F.xxhash64("text"), "_row"))["_row"].alias("_kept")).select("_kept"))
    one = rows.join(kept, F.col("_row") == F.col("_kept"), "left_semi").select(*docs.columns)
    return left.join(several, again, "left_anti").union(one)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that an earlier document has."""
    return passages.without_repeats(docs, passages.repeated_passages(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item."""
    return decontaminate.without_leaks(docs, decontaminate.leaks(docs, read_table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents into sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), eos=1)


STAGES = [
    ("quality", rate_quality),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: No stage but the joins can be written in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the
    session's checkpoint folder and read again."""
    prepare(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
