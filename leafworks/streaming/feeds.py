"""Streaming forms of append-driven reports; on the same rows they equal the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """A stream of Parquet files with like's schema; ets is ts as an instant, for watermarks."""
    rows = spark.readStream.schema(like.schema).parquet(folder)
    return rows.withColumn("ets", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """event_type, day (text), n over day-long windows; in append mode a day comes out once it is late past its end."""
    by = events.withWatermark("ets", late).groupBy("event_type", F.window("ets", "1 day").alias("w"))
    return by.agg(F.count("*").alias("n")).select("event_type", F.to_date("w.start").cast("string").alias("day"), "n")


def merged_checks(checks: DataFrame) -> DataFrame:
    """The monotone merge of check results as a running aggregate: candidate_id, check_name, status."""
    status = F.when(F.max((F.col("status") == "failed").cast("int")) == 1, "failed").otherwise(F.max_by("status", "seq"))
    return checks.groupBy("candidate_id", "check_name").agg(status.alias("status"))


def latest_state(events: DataFrame) -> DataFrame:
    """user_id, event_type, events: the last state of each key as a running aggregate."""
    return events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.count("*").alias("events"))


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there and returns its result, written as Parquet beside the checkpoint by the executors.

    In complete mode each batch replaces the one before; in append mode each has a folder of its own, which a repeated batch overwrites.
    """
    spark, out = stream.sparkSession, f"{checkpoint}-result"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/none")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{'all' if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/*")


def append_audit(events: DataFrame, folder: str, checkpoint: str, kind: str = "kind") -> StreamingQuery:
    """Appends a stream of events to an audit folder, a subfolder for each batch and in it one for each kind; a batch that is repeated after a failure replaces its own subfolder, so an event is there once however often its batch is tried.

    Runs over all that is there, then stops; started again with the same checkpoint it goes on with what is new.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(kind).parquet(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_trail(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All that append_audit() has written to a folder; nothing where no batch has come yet."""
    known = spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).parquet(folder).select(*known.columns)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return known


CHANGE = "page_id long, page_hash string, seq long"


def page_changes(pages: DataFrame) -> DataFrame:
    """page_id, page_hash, seq of a stream of pages (page_id, seq, text): those whose text differs from the page's last one. The state is a hash a page; within a batch a page's rows go by seq.

    Texts are hashed before the shuffle, so a row of a page with very many changes in a batch takes 12 characters and a number. Null text counts as empty.
    """

    def changed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable", ignore_index=True)
        before = rows["page_hash"].shift(fill_value=state.get[0] if state.exists else "")
        state.update((rows["page_hash"].iat[-1],))
        yield rows.loc[rows["page_hash"] != before, ["page_id", "page_hash", "seq"]]

    page_hash = F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 12)
    rows = pages.select(F.col("page_id").cast("long"), page_hash.alias("page_hash"), F.col("seq").cast("long"))
    return rows.groupBy("page_id").applyInPandasWithState(changed, CHANGE, "page_hash string", "append", GroupStateTimeout.NoTimeout)
