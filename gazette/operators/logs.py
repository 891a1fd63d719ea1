"""Interaction log: one entry per prompt and response, partitioned by day."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.sources.tables import read_if_any

# Fixed value: the rule that closes an entry.
RULE = "=" * 50


def log_entry(prompt: Column, response: Column) -> Column:
    """Text of one log entry."""
    return F.concat(
        F.lit("\n=== NOUVELLE INTERACTION ===\nPROMPT:\n"), prompt,
        F.lit("\n\nRÉPONSE:\n"), F.coalesce(response, F.lit("")), F.lit(f"\n\n{RULE}\n"),
    )


def interaction_log(interactions: DataFrame, log_date: datetime.date, enabled: bool) -> DataFrame:
    """Log rows for (prompt, response) pairs; none while logging is off."""
    prompt, response = F.col("prompt"), F.col("response")
    return interactions.where(F.lit(enabled)).select(
        "*",
        F.lit(log_date).alias("log_date"),
        F.length(prompt).alias("prompt_chars"),
        F.coalesce(F.length(response), F.lit(0)).alias("response_chars"),
        log_entry(prompt, response).alias("entry"),
    )


def write_log(log: DataFrame, path: str, log_date: datetime.date, run: str) -> None:
    """Log rows of a run below a folder of its day; a repeated run overwrites its own."""
    log.drop("log_date").write.mode("overwrite").parquet(f"{path}/log_date={log_date}/run={run}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(link, prompt, response, prompt_chars, response_chars, entry, log_date, run) of all days."""
    columns = (
        "link string, prompt string, response string, prompt_chars int, response_chars int, entry string,"
        " log_date date, run string"
    )
    return read_if_any(spark, path, columns)


def purge_logs(spark: SparkSession, path: str) -> int:
    """Delete every day of the log and return how many there were."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return 0
    days = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("log_date=")]
    return sum(1 for day in days if fs.delete(day, True))
