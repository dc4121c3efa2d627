"""Processing logs and jobs as streams; every function takes batch tables too, with the same results once all rows are in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stage_windows(events: DataFrame, ts: str = "ts", stage: str = "event_type", value: str = "value", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, stage, n, total): tumbling windows; entries later than the watermark are dropped from streams."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, size).alias("w"), F.col(stage).alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), "stage", "n", "total")


def session_runs(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): runs of entries that are less than the gap apart."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_requests(requests: DataFrame, sha: str = "sha", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """One request for each content hash, so that a recognizer reads equal images once."""
    if requests.isStreaming:
        return requests.withWatermark(ts, late).dropDuplicatesWithinWatermark([sha])
    return requests.dropDuplicates([sha])


def job_files(spark: SparkSession, folder: str, pattern: str = "*", per_batch: int = 100) -> DataFrame:
    """(path, length, modificationTime, content) of files as they arrive: the queue of jobs."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", str(per_batch)).load(folder)


def process_jobs(jobs: DataFrame, work, results: str, checkpoint: str):
    """A query that writes work(batch) of each micro-batch as Parquet; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{results}/batch={number}")

    return jobs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def job_states(jobs: DataFrame, started: DataFrame, results: DataFrame, timeout: float = 600.0) -> DataFrame:
    """(job_id, state): queued, processing, completed or failed. started: (job_id, seconds since), results: (job_id, error)."""
    both = jobs.select("job_id").join(started, "job_id", "left").join(results.withColumn("done", F.lit(True)), "job_id", "left")
    state = F.when(F.col("done") & F.col("error").isNull(), "completed").when(F.col("done") | (F.col("seconds") > timeout), "failed").when(F.col("seconds").isNotNull(), "processing").otherwise("queued")
    return both.select("job_id", state.alias("state"))
