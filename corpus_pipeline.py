"""From documents to packed training sequences, in five stages; each one's rows are written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massline.llm import common, mix, near_dup, packing, quality, secrets

#: No SQL: the first stage is a trained field over lines and the last one an online packing. Tests hold every stage
#: against a plain version instead.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field takes for good."""
    field = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.score(docs, field).where(F.col("score") >= quality.THRESHOLD).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five-word shingles at a similarity of 0.8: the smallest id.

    Different texts that share an id are different documents; rows that repeat an id and a text count as one. Texts
    without words and rows without an id belong to no group and stay.
    """
    found = near_dup.groups(docs, common.Scratch(spark, "near"), width=5, num=80, den=100)
    one = found.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "th")).alias("x")).select("x.*")
    bare = found.where("group is null and doc_id is not null").select("doc_id", "th")
    kept = docs.withColumn("_th", F.xxhash64("text")).join(one.unionAll(bare).select(F.col("doc_id").alias("_id"), F.col("th").alias("_t")), (F.col("doc_id").cast("long") == F.col("_id")) & (F.col("_th") == F.col("_t")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_th"]).select(docs.columns).unionAll(docs.where("doc_id is null"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text give way to a mark; n_chars follows the text."""
    out = secrets.redact(secrets.scan(docs)).drop("spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes, the last one cut behind the last word taken."""
    out = mix.mix(docs)
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    out = out.where("taken > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    rest = F.col("taken") - (F.col("_copy") - 1) * F.col("size")
    out = out.withColumn("text", F.when(rest < F.col("size"), mix.head(F.col("text"), rest)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.default_path(), common.Scratch(spark, "pack"))


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", one_of_each_group),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
