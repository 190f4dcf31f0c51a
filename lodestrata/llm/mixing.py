"""Mixing sources to target weights: a token budget is handed down a tree domain > language > source and each leaf gives a prefix of its documents.

At each node the budget is shared among the children by weight, but none gets more than its subtree can give (its tokens times the epochs
allowed). What a child can't use goes to its siblings first, by weight again; only what all of them can't use was never given to their parent,
as the parent's own limit is the sum of theirs, and so went to the parent's siblings. Shares are whole tokens, rounded down.

A leaf with quota q and t tokens gives all its documents q div t times (epochs 0, 1, ...) and of one more epoch the longest prefix of at most
q mod t tokens, in the order of md5("seed:epoch:id"); documents with equal ids come in or stay out together. The prefix is found without sorting
a leaf: tokens are summed by leaf and the key's first four hex digits, those sums by the first two; running sums over the 256 parts of a leaf, and then
over the 256 buckets of the part in which the budget ends, give the bucket in which it ends, and only that bucket's rows (1/65536 of the leaf) are put
in order, which gives the last key that is taken. Documents without an id have the hash of their text in the key instead.

DataFrame functions only. Nulls: a null text has no tokens; null domains, languages and sources are the empty name. A leaf without tokens gives all its documents
once; a leaf of weight zero gives none beside siblings that can use the budget. Other columns pass through untouched; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop_written, fresh, written

SEED, EPOCHS, DIGITS = 42, 2, 4
LEVELS = ("domain", "lang", "source")


def word_tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def weight(name: str, weights: dict[str, int]) -> Column:
    """The whole-number weight of each name; 1 where weights doesn't list it."""
    return reduce(lambda c, kv: c.when(F.col(name) == kv[0], F.lit(kv[1])), weights.items(), F.when(F.lit(False), F.lit(1))).otherwise(F.lit(1)).cast("bigint")


def shares(children: DataFrame, parent: list[str]) -> DataFrame:
    """children (parent columns, budget, cap, weight and others) with their quota: the budget in proportion to weight, none above its cap."""
    order = Window.partitionBy(*parent).orderBy((F.col("cap") / F.when(F.col("weight") > 0, F.col("weight"))).asc_nulls_last(), *LEVELS[: len(parent) + 1])
    before, onwards = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    ranked = children.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("heft", F.sum("weight").over(onwards))
    full = (F.col("weight") > 0) & (big("cap") * big("heft") <= big("left") * big("weight"))
    first = F.min_by(F.struct("left", "heft"), F.when(~F.col("full"), F.col("rank"))).over(Window.partitionBy(*parent))
    ranked = ranked.withColumn("rank", F.row_number().over(order)).withColumn("full", full).withColumn("first", first)
    part = F.expr("CASE WHEN first.heft > 0 THEN (CAST(first.left AS DECIMAL(19,0)) * CAST(weight AS DECIMAL(19,0))) DIV first.heft ELSE 0 END").cast("bigint")
    return ranked.withColumn("quota", F.when(F.col("full"), F.col("cap")).otherwise(F.least(part, F.col("cap")))).drop("left", "heft", "rank", "full", "first")


def quotas(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: int, epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens) with the quota of each."""
    level: DataFrame | None = None
    for depth in (1, 2, 3):
        names, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        nodes = leaves.groupBy(*names).agg((F.sum("tokens") * epochs).alias("cap")).withColumn("weight", weight(names[-1], weights.get(names[-1], {})))
        nodes = nodes.withColumn("budget", F.lit(budget).cast("bigint")) if level is None else nodes.join(level.select(*parent, F.col("quota").alias("budget")), parent)
        level = shares(nodes, parent)
    return leaves.join(level.select(*LEVELS, "quota"), list(LEVELS))


def plan(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], budget: int | None = None, epochs: int = EPOCHS, seed: int = SEED, tokens: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """One row for each leaf: its names, quota, whole epochs, and the last key that is taken of the epoch after them (empty: none)."""
    named = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    slim = docs.select(named(domain).alias("domain"), named(F.col("lang")).alias("lang"), named(F.col("source")).alias("source"), _name(id_col).alias("id"), (word_tokens() if tokens is None else tokens).alias("tokens"))
    slim = written(slim, "mix-documents")
    leaves = written(slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    whole = F.when(F.col("tokens") > 0, F.expr("quota DIV tokens")).otherwise(F.lit(1)).cast("int")
    given = quotas(leaves, weights, total if budget is None else budget, epochs).withColumn("whole", whole)
    given = written(given.withColumn("rest", F.col("quota") - F.when(F.col("tokens") > 0, F.col("whole") * F.col("tokens")).otherwise(F.lit(0))).drop("tokens"), "mix-quotas")

    keyed = slim.join(given.filter("rest > 0"), list(LEVELS)).withColumn("key", key_of(F.col("id"), F.col("whole"), seed)).withColumn("bucket", F.substring("key", 1, DIGITS))
    sums = keyed.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("tokens").alias("tokens"))
    parts = sums.groupBy(*LEVELS, "rest", F.substring("bucket", 1, DIGITS // 2).alias("part")).agg(F.sum("tokens").alias("tokens"))
    part = _ends(parts.withColumn("before", F.lit(0)), "part").select(*LEVELS, F.col("end.at").alias("part"), F.col("end.before").alias("before"))
    inner = sums.withColumn("part", F.substring("bucket", 1, DIGITS // 2)).join(part, [*LEVELS, "part"])
    ends = _ends(inner, "bucket").select(*LEVELS, F.struct(F.col("end.at").alias("bucket"), F.col("end.before").alias("before")).alias("end"))
    ends = written(ends.select(*LEVELS, F.col("end.bucket").alias("bucket"), F.col("end.before").alias("before")), "mix-ends")
    inside = keyed.join(ends, [*LEVELS, "bucket"]).withColumn("till", F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEVELS, "bucket").orderBy("key")))
    taken = inside.filter("till <= rest").groupBy(*LEVELS).agg(F.max("key").alias("within"))
    # Within the last bucket nothing may fit: then all keys of the buckets before it, which sort before the bucket's own digits.
    last = ends.join(taken, list(LEVELS), "left").select(*LEVELS, F.coalesce("within", "bucket").alias("last"))
    out = written(given.join(last, list(LEVELS), "left").select(*LEVELS, "quota", "whole", F.coalesce("last", F.when(F.col("rest") > 0, F.lit("g")).otherwise(F.lit(""))).alias("last")), "mix-plan")
    for table in (slim, leaves, given, ends):
        drop_written(table)
    return out


def _ends(sums: DataFrame, at: str) -> DataFrame:
    """Of each leaf the first part at which the running sum of tokens goes over rest, and the sum before it. Rows of a leaf: 256 at most."""
    till = F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy(at))
    over = sums.withColumn("till", till).filter("till > rest")
    return over.groupBy(*LEVELS).agg(F.min_by(F.struct(F.col(at).alias("at"), (F.col("till") - F.col("tokens")).alias("before")), at).alias("end"))


def _name(id_col: str) -> Column:
    """The id as text, or for none the hash of the text."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce("text", F.lit("")))))


def key_of(name: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), name))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], budget: int | None = None, epochs: int = EPOCHS, seed: int = SEED, tokens: Column | None = None, id_col: str = "doc_id", out: str = "epoch") -> DataFrame:
    """docs, each row once for every epoch that takes it, with the epoch's number. weights: whole numbers by level and name, 1 where none is given; budget: in tokens, by default as many as docs have."""
    d, la, so, last, whole = fresh(docs, *LEVELS, "last", "whole")
    leaf = plan(docs, domain, weights, budget, epochs, seed, tokens, id_col).select(F.col("domain").alias(f"{d}_"), F.col("lang").alias(f"{la}_"), F.col("source").alias(f"{so}_"), F.col("last").alias(last), F.col("whole").alias(whole))
    on = [F.coalesce(c.cast("string"), F.lit("")) == F.col(n) for c, n in ((domain, f"{d}_"), (F.col("lang"), f"{la}_"), (F.col("source"), f"{so}_"))]
    copies = F.col(whole) + (key_of(_name(id_col), F.col(whole), seed) <= F.col(last)).cast("int")
    chosen = docs.join(leaf, on).withColumn(whole, copies).filter(F.col(whole) > 0)
    return chosen.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col(whole) - 1)).alias(out))


#: The parameters of the registered query and of the pipeline: sources src0, src1, ... belong to four domains in turn.
DOMAINS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 11, "de": 3, "fr": 3, "es": 3}, "source": {"src0": 2}}


def source_domain() -> Column:
    return F.concat(F.lit("domain"), (F.expr("try_cast(substring(source, 4) AS INT)") % 4).cast("string"))
