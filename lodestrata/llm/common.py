"""What the operators of this subpackage share: scratch tables, fresh column names, word splitting, labelled samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the space and U+0009 to U+000D. ``bytes.split()`` splits at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; in local mode, where it is unset, a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str | None = None, group: int | None = None) -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage, and a lost executor costs no recomputation. group: bytes of a row group, for tables of long rows. Writers and readers
    hold one row group at a time; unless told so Parquet looks at its size after a hundred rows first and then where it expects the end from the rows so far."""
    path = scratch_path(df.sparkSession, name)
    bounds = {"parquet.block.size": group, **{f"parquet.{of}.size.row.check.{end}": 1 for of in ("block", "page") for end in ("min", "max")}} if group else {}
    df.write.options(**bounds).parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Bytes of an Arrow batch that goes to a Python worker; Spark's default is 64 MB, of which both the executor and the worker hold a few.
BATCH_BYTES = "8m"


def _bounded(spark: SparkSession | None) -> None:
    """Batches of at most about BATCH_BYTES in this session, unless the session has a bound of its own."""
    spark, key = spark or SparkSession.active(), "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def map_batches(df: DataFrame, each, schema: str) -> DataFrame:
    """df.mapInArrow over batches of bounded size."""
    _bounded(df.sparkSession)
    return df.mapInArrow(each, schema)


def arrow_column(each, kind: str, *columns: Column | str) -> Column:
    """An Arrow function of columns over batches of bounded size. Not deterministic in name only: so that no filter makes Spark run it twice."""
    _bounded(None)
    return F.arrow_udf(each, kind).asNondeterministic()(*columns)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df is called so (upper or lower case alike)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds. Null ids have no fold."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def labelled_sample(labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label): at most per_class ids of either class, those with the smallest hashes. Conflicting rows of an id: the smaller label."""
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg(F.min(label).cast("int").alias("label"))
    side = lambda v: one.filter(F.col("label") == v).orderBy(F.xxhash64(id_col), id_col).limit(per_class)
    return side(0).unionByName(side(1))


def class_weights(labels: DataFrame, label: str, sampled: dict[int, int]) -> dict[int, float]:
    """How many labelled rows each row of a sample stands for, by class: 1 where the bound took none away."""
    n = {r["c"]: r["count"] for r in labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col(label).cast("int").alias("c")).count().collect()}
    return {c: max(1.0, n.get(c, 0) / k) for c, k in sampled.items() if k}


def learnable(labels: DataFrame, folds: int, held: int) -> DataFrame:
    """The rows of labels outside the held-out fold."""
    return labels.filter(fold("doc_id", folds) != held)
