"""Structured Streaming form of the request analysis (O-40).

Requests arrive as JSON-lines files (``request_id, body``) in a folder. Every
request is one row and carries its whole document, so all work up to the
report is narrow and stateless. ``foreachBatch`` keeps the parsed batch while it
writes the reports (with the annotated map) and the rejects from it.
Each batch is written to its own ``batch_id=N`` folder in overwrite mode, so
a batch replayed after a failure replaces its own output: exactly-once
results from an at-least-once trigger. Rejected requests go to a quarantine
folder the same way.

``start(.., once_within="7 days")`` adds state: a request id is answered once, also
when a producer sends it again in a later batch, and a request rejected for a
reason is reported once with it (a corrected request of that id is still answered).
The state is one row per id and reason, kept for that long after the *arrival* of the
request's file; a request is never late, however old it says it is. The state commits
with the batch, so a batch that is replayed after a failure sees the state before it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clausewise.plans.analyse import rule_report
from clausewise.sources import requests

RAW_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("body", T.StringType()),
])


def write_request_files(raw: DataFrame, folder: str, files: int = 2) -> None:
    """Drop raw requests into the watched folder (used by tests and demos)."""
    raw.repartition(files).write.mode("append").json(folder)


def answered_once(raw: DataFrame, within: str) -> DataFrame:
    """Parsed requests without those whose id came before (with the same ``reason``)."""
    timed = raw.select("request_id", "body", F.col("_metadata.file_modification_time").alias("arrived"))
    parsed = requests.parse(timed, keep=["arrived"]).withWatermark("arrived", within)
    return parsed.dropDuplicatesWithinWatermark(["request_id", "reason"]).drop("arrived")


def start(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
          mode: str = "tfm", available_now: bool = True, once_within: str | None = None) -> StreamingQuery:
    stream = spark.readStream.schema(RAW_SCHEMA).json(in_dir)
    parsed = requests.parse(stream) if once_within is None else answered_once(stream, once_within)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        report = rule_report(requests.valid(batch).withColumnRenamed("request_id", "doc_id"), mode)
        (report.select("doc_id", "alertness", "title", "standard_n", "worth_n", "error_n",
                       "standard_ratio", "worth_indices", "clause_map")
               .write.mode("overwrite").parquet(os.path.join(out_dir, "reports", f"batch_id={batch_id}")))
        (requests.rejected(batch)
               .write.mode("overwrite").parquet(os.path.join(out_dir, "rejected", f"batch_id={batch_id}")))
        batch.unpersist()

    writer = (parsed.writeStream.foreachBatch(per_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def read_reports(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(out_dir, "reports")).drop("batch_id")
