"""Token files: tab-separated columns, a header per document, segment starts in the last column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = r"^# newdoc_id = (.*)$"
START = "BeginSeg=Yes"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, id, line: the lines of every text file under the path, a large file by as many tasks as it has blocks.

    block is where a task's part of the file begins, and id ascends within it, so (block, id) is the order of a file.
    """
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, pos, token, is_start. Ranges such as 1-2 and blank lines are skipped; lines before a header have no document and go.

    A header counts to the next one. Within a block it is carried along; what a block begins with comes from a table of
    one row per block, so that no task holds a file.
    """
    rows = lines(spark, path).withColumn("head", F.when(F.col("line").rlike(HEADER), F.trim(F.regexp_extract("line", HEADER, 1))))
    last = rows.where("head is not null").groupBy("file", "block").agg(F.max_by("head", "id").alias("head"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.select("file", "block").distinct().join(last, ["file", "block"], "left").select("file", "block", F.last("head", ignorenulls=True).over(ahead).alias("carried"))
    within = F.last("head", ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("id"))
    rows = rows.withColumn("own", within).join(starts, ["file", "block"]).withColumn("doc_id", F.coalesce("own", "carried"))
    cols = F.split("line", "\t")
    rows = rows.where(~F.col("line").startswith("#") & (F.trim("line") != "") & (F.size(cols) >= 2)).withColumn("c", cols)
    rows = rows.where(~F.element_at("c", 1).contains("-") & F.col("doc_id").isNotNull())
    pos = F.row_number().over(Window.partitionBy("file", "doc_id").orderBy("block", "id"))
    return rows.select("doc_id", pos.alias("pos"), F.element_at("c", 2).alias("token"), F.array_contains(F.split(F.element_at("c", -1), r"\|"), START).alias("is_start"))
