"""The ledger of intake runs: start, heartbeat, finish, resume, reclaim; and when a source is due.

Every function takes the ledger and gives the next one; the caller writes it, as a single job does.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUNS = "run_id string, host string, config_digest string, status string, started_at timestamp, last_progress_at timestamp, finished_at timestamp"


def start(ledger: DataFrame, run_id: str, host: str, digest: str, at: datetime) -> DataFrame:
    row = ledger.sparkSession.createDataFrame([(run_id, host, digest, "running", at, at, None)], RUNS)
    return ledger.join(row.select("run_id"), "run_id", "left_anti").unionByName(row)


def progress(ledger: DataFrame, run_id: str, at: datetime) -> DataFrame:
    own = F.col("run_id") == run_id
    return ledger.withColumn("last_progress_at", F.when(own, F.greatest("last_progress_at", F.lit(at))).otherwise(F.col("last_progress_at")))


def finish(ledger: DataFrame, run_id: str, at: datetime, status: str = "done") -> DataFrame:
    own = F.col("run_id") == run_id
    return ledger.withColumn("status", F.when(own, status).otherwise(F.col("status"))).withColumn("finished_at", F.when(own, F.lit(at)).otherwise(F.col("finished_at")))


def reclaim(ledger: DataFrame, now: datetime, seconds: int) -> DataFrame:
    """Running rows without progress for that long have failed."""
    stale = (F.col("status") == "running") & (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("last_progress_at") > seconds)
    return ledger.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def resumable(ledger: DataFrame, digest: str) -> DataFrame:
    """The latest unfinished run of each host with that configuration."""
    w = Window.partitionBy("host").orderBy(F.desc("started_at"), F.desc("run_id"))
    return ledger.where((F.col("status") != "done") & (F.col("config_digest") == digest)).withColumn("nr", F.row_number().over(w)).where("nr = 1").drop("nr")


def due(sources: DataFrame, scans: DataFrame, now: datetime, max_age_seconds: float) -> DataFrame:
    """Sources never scanned or last scanned longer ago than the age."""
    last = scans.groupBy("source").agg(F.max("scanned_at").alias("last"))
    return sources.join(last, "source", "left").where(F.col("last").isNull() | (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("last") > max_age_seconds)).drop("last")
