"""Incremental ingest of a growing folder of opinion records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources.store import parse_lines


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> tuple[int, int]:
    """Read the JSONL files that came since the last call and append records whose
    ids the target lacks; lines that can't be read go to ``<target>-bad``. Gives the
    numbers of records and of bad lines. Each file is read once (the checkpoint
    remembers), a batch that failed is done again whole: its rows are told by their
    batch number, and what an earlier try left of it goes first."""
    counts = [0, 0]

    def put(batch: DataFrame, epoch: int) -> None:
        good, bad = parse_lines(batch)
        new = good.dropDuplicates(["scholar_id"])
        if _exists(spark, target):
            old = spark.read.parquet(target).where(F.col("batch") != epoch).select("scholar_id")
            new = new.join(old, "scholar_id", "left_anti")
        for k, (rows, path) in enumerate(((new, target), (bad, f"{target}-bad"))):
            rows.withColumn("batch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
            done = f"{path}/batch={epoch}"
            counts[k] += spark.read.parquet(done).count() if _exists(spark, done) else 0

    query = spark.readStream.text(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return counts[0], counts[1]


def rate_limited(events: DataFrame, by: str, at: str, gap: str) -> DataFrame:
    """Streaming or batch: events of a key by windows of ``gap``, late rows up to
    an hour; count and first time of each window."""
    if events.isStreaming:
        events = events.withWatermark(at, "1 hour")
    return events.groupBy(by, F.window(at, gap)).agg(F.count("*").alias("n"), F.min(at).alias("first"))
