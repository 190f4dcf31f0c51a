"""Stored tables that batches are merged into: only the files of the keys that a batch touches are written anew.

A table is a folder with data, in parts by a hash of the key, and log, a row for each batch. A merge reads the parts that the batch has keys of, replaces and adds rows, writes the result beside the table and then over those parts (dynamic
partition overwrite); no other file is touched. A batch has an id, and one that is in the log already changes nothing. A run that dies after the data was written and before the log was is repeated as a whole, with the same
result, as each of its rows takes the place of itself. One merge of a table may run at a time.

Rows with a null among their keys can't be replaced by a later batch; they are left out and counted in the log. Of rows of a batch with one key the greatest in order counts (relations.last_rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import relations
from .stored import stored

PARTS, PART = 64, "_part"
LOG = "version long, batch string, parts array<int>, rows long, rejected long, at timestamp"


def _parted(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    return rows.withColumn(PART, F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(parts)).cast("int"))


def _whole(rows: DataFrame, keys: list[str]) -> Column:
    return relations.all_of(*(F.col(k).isNotNull() for k in keys))


def _write(rows: DataFrame, path: str) -> None:
    rows.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{path}/data")


def log(spark: SparkSession, path: str) -> DataFrame:
    """The batches of a table in order of version."""
    return spark.read.schema(LOG).parquet(f"{path}/log").orderBy("version")


def _logged(spark: SparkSession, path: str, batch: str, parts: list[int], rows: int, rejected: int, version: int) -> None:
    row = spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(batch).alias("batch"), F.array(*(F.lit(p) for p in parts)).cast("array<int>").alias("parts"), F.lit(rows).cast("long").alias("rows"), F.lit(rejected).cast("long").alias("rejected"), F.current_timestamp().alias("at"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/log")


def create(rows: DataFrame, path: str, keys: list[str], batch: str = "create", parts: int = PARTS, order: Column | None = None) -> None:
    """A new table of rows, one for each key."""
    good = relations.last_rows(rows.filter(_whole(rows, keys)), keys, order)
    _write(_parted(good, keys, parts), path)
    _logged(rows.sparkSession, path, batch, list(range(parts)), rows.count(), rows.filter(~_whole(rows, keys)).count(), 0)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data").drop(PART)


def merge(delta: DataFrame, path: str, keys: list[str], batch: str, columns: list[str] | None = None, order: Column | None = None, insert: bool = True) -> bool:
    """delta merged into the table by relations.upsert; whether it was: False for a batch that the table has."""
    spark = delta.sparkSession
    known = log(spark, path)
    first, last = known.agg(F.min_by("parts", "version"), F.max("version")).first()
    if not known.filter(F.col("batch") == batch).isEmpty():
        return False
    delta = stored(_parted(delta, keys, len(first)))
    good = delta.filter(_whole(delta, keys))
    touched = sorted(r[PART] for r in good.select(PART).distinct().collect())  # as many as there are parts at most
    if touched:
        base = spark.read.parquet(f"{path}/data").filter(F.col(PART).isin(touched))
        made = relations.upsert(base.drop(PART), good.drop(PART), keys, columns, order, insert)
        _write(_parted(stored(made.select(base.drop(PART).columns)), keys, len(first)), path)
    n = delta.count()
    _logged(spark, path, batch, touched, n, n - good.count(), last + 1)
    return True


def merge_stream(stream: DataFrame, path: str, keys: list[str], name: str, order: Column | None = None):
    """A writer that merges each micro-batch under its own number, so that a batch which a restarted stream repeats changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, n: merge(batch, path, keys, f"{name}-{n}", order=order) and None)
