"""Webhook events as a stream (C1, C3, C6, C7): routing, keyed dedup by content, incremental processing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = "delivery_id string, event string, payload string, received_at timestamp"
ACTIONS = ["opened", "reopened", "synchronize", "closed"]


def route() -> Column:
    """The handler of an event, by its name and the payload's action."""
    action = F.get_json_object("payload", "$.action")
    event = F.col("event")
    return (
        F.when(event == "ping", "pong").when((event == "pull_request") & action.isin(ACTIONS), "pull_request").when(event == "push", "push")
        .when(event.isin("installation", "installation_repositories"), "installation").otherwise("ignored")
    )


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 50) -> DataFrame:
    """JSON files of a folder as a stream of events."""
    return spark.readStream.schema(T._parse_datatype_string(EVENT)).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def routed(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Events with their route, each delivery once within the watermark."""
    return events.withWatermark("received_at", watermark).dropDuplicatesWithinWatermark(["delivery_id"]).withColumn("route", route())


def default_branch_pushes(events: DataFrame) -> DataFrame:
    """Pushes to the repository's default branch."""
    ref, branch = F.get_json_object("payload", "$.ref"), F.get_json_object("payload", "$.repository.default_branch")
    return events.filter((F.col("event") == "push") & (ref == F.concat(F.lit("refs/heads/"), branch)))


def changed_contents(stream: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Rows whose content differs from the last one of their key; the state per key is one hash."""
    import pandas as pd

    def keep(key: tuple, frames, state):
        last = state.get[0] if state.exists else None
        for f in frames:
            out = []
            for r in f.sort_values("_t").itertuples(index=False):
                if r.content_hash != last:
                    last = r.content_hash
                    out.append((*key, r.content_hash))
            if out:
                yield pd.DataFrame(out, columns=[*keys, "content_hash"])
        state.update((last,))

    rows = stream.select(*keys, F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("content_hash"), F.col("received_at").alias("_t"))
    out = ", ".join(f"{k} string" for k in keys) + ", content_hash string"
    return rows.groupBy(*keys).applyInPandasWithState(keep, out, "last string", "append", "NoTimeout")


def process_new(stream: DataFrame, table: str, keys: list[str], transform: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Each micro-batch's rows that the parquet table lacks, transformed and appended; runs to the end of the input."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        new = transform(df)
        try:
            old = spark.read.parquet(table).select(*keys)
            new = new.join(old, keys, "left_anti")
        except Exception as e:  # the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.dropDuplicates(keys).write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
