"""Keyed table operations (K1 to K5, K8, K9): insert if absent, update, delete, export, events, dead letters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_writer(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key; a window group limit keeps hot keys small before the shuffle."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def insert_if_absent(table: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """K1/K2: the rows of ``new`` whose key the table lacks, one a key; nulls in keys are equal."""
    cond = reduce(lambda a, b: a & b, [F.col(f"n.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    return first_writer(new, keys, order).alias("n").join(table.select(*keys).distinct().alias("t"), cond, "left_anti")


def update_by_key(table: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """K3: the named columns replaced where the changes have a value."""
    renamed = changes.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = table.join(renamed, keys, "left")
    return joined.select(*(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))


def update_where(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """K4: columns set where the condition is true."""
    return table.select(*(F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns))


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """K4: rows without those for which the condition is true; null is not true."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def export_csv(report: DataFrame, path: str, columns: list[str]) -> None:
    """K5: a bounded report as one CSV file with a header."""
    report.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def event_row(spark, stage: str, status: str, items: int, duration_ms: int | None, error: str = "") -> DataFrame:
    """K8: a row to append to the pipeline events."""
    schema = "stage string, status string, items_processed int, duration_ms int, error_message string"
    return spark.createDataFrame([(stage, status, items, duration_ms, error[:2000])], schema).withColumn("created_at", F.current_timestamp())


def retry(failed: DataFrame, task_id: str) -> DataFrame:
    """The counter of a failed task raised by one."""
    return update_where(failed, F.col("task_id") == task_id, {"retry_count": F.col("retry_count") + 1})


def dead_letters(events: DataFrame) -> DataFrame:
    """K9: tasks whose last event is a failure: ``task_id``, ``stage``, ``error_message`` (2,000 characters) and ``retries``; append to the failed tasks."""
    e = events.filter("task_id <> ''").groupBy("task_id").agg(F.max_by(F.struct("status", "stage", "error_message"), F.struct("created_at", "event_id")).alias("_l"), F.count_if(F.col("status") == "failed").alias("retries"))
    return e.filter("_l.status = 'failed'").select("task_id", F.lower("_l.stage").alias("stage"), F.substring("_l.error_message", 1, 2000).alias("error_message"), "retries")


def append(rows: DataFrame, path: str, keys: list[str]) -> None:
    """K2, K9: rows whose keys a parquet table lacks are appended, so that a repeated write adds nothing."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    old = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    new = rows.dropDuplicates(keys)
    (new.join(spark.read.parquet(path).select(*keys), keys, "left_anti") if old else new).write.mode("append").parquet(path)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, the first by a hash of the key and the seed."""
    return rows.orderBy(F.sha2(F.concat(F.col(key), F.lit(f":{seed}")), 256), key).limit(n)


def backfill_code(chunks: DataFrame, whole: str = "module") -> DataFrame:
    """``chunk_id`` and ``raw_code`` of chunks without code: lines ``start_line`` to ``end_line`` of their file, without blanks at the end.

    The file is the row of type ``whole`` with code of the same repository, commit and path (of several the one of the least
    id); lines end as for a text file. Chunks without such a file, or of blank lines only, have no row.
    """
    keys = ["repo_id", "commit_id", "file_path"]
    files = chunks.filter((F.col("chunk_type") == whole) & F.col("raw_code").isNotNull()).groupBy(*keys).agg(F.min_by("raw_code", "chunk_id").alias("_whole"))
    first = F.greatest(F.lit(1), F.col("start_line"))
    cut = chunks.filter("raw_code is null").filter(F.col("end_line") >= first).select("chunk_id", *keys, "end_line", first.alias("_first")).join(files, keys)
    piece = F.array_join(F.slice(F.split("_whole", r"\r\n|\r|\n", -1), F.col("_first"), F.col("end_line") - F.col("_first") + 1), "\n")
    stripped = F.regexp_replace(piece, r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+\z", "")
    return cut.select("chunk_id", stripped.alias("raw_code")).filter("raw_code <> ''")
