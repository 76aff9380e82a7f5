"""Streams: a circuit breaker over draws, and windowed counts of events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Share of failed draws beyond which a run stops.
MOST_FAILED = 0.10


def guarded(draws: DataFrame, sink: str, checkpoint: str, most: float = MOST_FAILED, least: int = 20) -> StreamingQuery:
    """Appends each batch of (status, ...) to Parquet; a batch that raises the share of failures too far ends the stream unwritten.

    A batch is computed once, judged with all before it and only then written, under its number, so that one that is
    repeated after a failure replaces itself. What earlier batches counted stands in a table beside the checkpoint, a row
    for each, so that a restarted stream goes on from there.
    """
    counts = f"{checkpoint.rstrip('/')}_counts"
    schema = "n long, failed long, batch long"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            n, bad = batch.agg(F.count("*"), F.count_if(F.col("status") != "ok")).first()
            known = spark.read.schema(schema).option("ignoreMissingFiles", "true").parquet(counts) if _exists(spark, counts) else spark.createDataFrame([], schema)
            before = known.where(F.col("batch") < number).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("failed"), F.lit(0))).first()
            total, failed = before[0] + n, before[1] + bad
            if total >= least and failed > most * total:
                raise RuntimeError(f"{failed} of {total} draws failed")
            batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")
            spark.createDataFrame([(n, bad)], "n long, failed long").coalesce(1).write.mode("overwrite").parquet(f"{counts}/batch={number}")
        finally:
            batch.unpersist()

    return draws.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by type in windows of event time; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")
