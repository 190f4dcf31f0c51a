"""Versioned relations: upsert, insert-if-absent, duplicate reports, diffs, gates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def last_rows(rows: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """One row for each key: the greatest in order (by default in all columns), of equal ones the greatest in all columns that have an order. A null order comes before all others. Rows with a null among their keys all stay."""
    whole = reduce(and_, (F.col(k).isNotNull() for k in keys))
    own, orderable = F.struct(*rows.columns), [f.name for f in rows.schema.fields if not _has_map(f.dataType)]
    by = F.struct(*([order.isNotNull(), order] if order is not None else []), *orderable)
    return rows.filter(whole).groupBy(*keys).agg(F.max_by(own, by).alias("r")).select("r.*").unionByName(rows.filter(~whole))


def _has_map(kind: DataType) -> bool:
    return kind.typeName() in ("map", "variant") or any(_has_map(k) for k in ([kind.elementType] if isinstance(kind, ArrayType) else [f.dataType for f in kind.fields] if isinstance(kind, StructType) else []))


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], columns: list[str] | None = None, order: Column | None = None, insert: bool = True) -> DataFrame:
    """base with the rows of delta in place of those with their keys, and the other rows of delta after them. Of delta's rows with one key the greatest in order counts; null keys never match.

    columns: rows that are there keep all but these, and rows that come new have null in what delta lacks. insert: whether new rows come at all. One shuffle of either side by key."""
    delta = last_rows(delta, keys, order)
    if columns is None:
        rest = base.join(delta.select(*keys), keys, "left_anti")
        return rest.unionByName(delta if insert else delta.join(base.select(*keys).distinct(), keys, "left_semi"))
    news = delta.select(*keys, F.struct(*columns).alias("_new"))
    kept = base.join(news, keys, "left").select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))
    return kept.unionByName(delta.join(base.select(*keys), keys, "left_anti"), allowMissingColumns=True) if insert else kept


def insert_if_absent(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(last_rows(delta, keys).join(base.select(*keys), keys, "left_anti"))


def append_log(rows: DataFrame, path: str, at: Column | None = None) -> None:
    """rows appended to a table that only grows, with the time that they were logged."""
    rows.withColumn("logged_at", F.current_timestamp() if at is None else at).write.mode("append").parquet(path)


def latest_flag(rows: DataFrame, keys: list[str], version: str, out: str = "is_current") -> DataFrame:
    """True on the rows of each key's greatest version, false on all others, those without a version too."""
    return rows.withColumn(out, F.coalesce(F.col(version) == F.max(version).over(Window.partitionBy(*keys)), F.lit(False)))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often; the rows themselves stay where they are."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def version_diff(old: DataFrame, new: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, change_type, changed_fields) of rows added, removed or modified; equal rows are left out. Null equals null."""
    a, b = old.select(F.col(key), F.struct(*compared).alias("o")), new.select(F.col(key), F.struct(*compared).alias("n"))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in compared)))
    kind = F.when(F.col("o").isNull(), "ADDED").when(F.col("n").isNull(), "REMOVED").when(F.size(changed) > 0, "MODIFIED")
    fields = F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), changed).otherwise(F.array().cast("array<string>"))
    return a.join(b, key, "full_outer").select(key, kind.alias("change_type"), fields.alias("changed_fields")).filter("change_type IS NOT NULL")


def split_rejects(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows with the name of the first check each fails, null for good rows."""
    error = reduce(lambda c, kv: c.when(~F.coalesce(kv[1], F.lit(False)), F.lit(kv[0])), checks.items(), F.when(F.lit(False), F.lit("")))
    return rows.withColumn("reject_reason", error)


def gate(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row for each check: rows that fail it (null fails), and whether none does. One pass over rows."""
    failed = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()]
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("n_failed")) for n in checks)))
    return rows.agg(*failed).select(pairs.alias("r")).select("r.*", (F.col("r.n_failed") == 0).alias("passed"))


def coverage_gaps(left: DataFrame, right: DataFrame, present: DataFrame) -> DataFrame:
    """Pairs of the rows of two dimensions that present doesn't hold. All pairs are wanted of it, so the smaller side must be small: 10,000 rows at most."""
    few = min((left, right), key=lambda d: d.limit(10_001).count())
    if few.limit(10_001).count() > 10_000:
        raise ValueError("both sides have more than 10,000 rows")
    pairs = left.crossJoin(F.broadcast(right)) if few is right else right.crossJoin(F.broadcast(left))
    return pairs.select(*left.columns, *right.columns).join(present, [*left.columns, *right.columns], "left_anti")


def parse_summary(rows: DataFrame, reason: str = "reject_reason") -> DataFrame:
    """One row: total, good, rejected, and the share that is good (0 of none)."""
    good = F.count_if(F.col(reason).isNull())
    return rows.agg(F.count("*").alias("total"), good.alias("good"), (F.count("*") - good).alias("rejected"), F.coalesce(F.round(F.try_divide(good, F.count("*")), 6), F.lit(0.0)).alias("success_rate"))


def changes(diff: DataFrame) -> DataFrame:
    """How many rows of version_diff are of each kind."""
    return diff.groupBy("change_type").agg(F.count("*").alias("n"))


def all_of(*columns: Column) -> Column:
    return reduce(and_, columns)
