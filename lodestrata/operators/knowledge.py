"""Knowledge-base tables: graph nodes and edges from relations, anchors of groups, offline vectors, scopes by topic, evaluation reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import slice_name


def nodes(rows: DataFrame, label: str, key: str, *properties: str) -> DataFrame:
    """(label, id, properties): one node for each key; of repeated keys the smallest properties."""
    props = F.to_json(F.struct(*properties)) if properties else F.lit("{}")
    return rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("id")).agg(F.min(props).alias("properties")).select(F.lit(label).alias("label"), "id", "properties")


def edges(rows: DataFrame, kind: str, src: str, dst: str) -> DataFrame:
    """(src, dst, type), each once; rows without either end give none."""
    return rows.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), F.lit(kind).alias("type")).filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


def anchors(chunks: DataFrame, group: str, order: str, heading: str, cap: int = 10) -> DataFrame:
    """(group, n, first, headings): how many chunks a group has and its first distinct headings; no more than cap of them are ever gathered."""
    first = chunks.groupBy(group, heading).agg(F.min(order).alias("at"), F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.col(heading).isNull(), "at", heading)
    placed = first.withColumn("place", F.row_number().over(w))
    named = F.transform(F.array_sort(F.collect_list(F.when(F.col(heading).isNotNull() & (F.col("place") <= cap), F.struct("at", heading)))), lambda x: x[heading])
    return placed.groupBy(group).agg(F.sum("n").alias("n"), F.min("at").alias("first"), named.alias("headings"))


def chapters(chunks: DataFrame, pub: str, chapter: str, order: str, general: str = "(General)", least: int = 3) -> DataFrame:
    """(pub, chapter, n, first): the chapters of each publication with their chunks; those of no chapter are one of that name, if there are enough."""
    named = chunks.withColumn("chapter", F.coalesce(F.nullif(chapter, F.lit("")), F.lit(general)))
    return named.groupBy(pub, "chapter").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter((F.col("chapter") != general) | (F.col("n") >= least))


def hashed_vector(words: Column, size: int = 64) -> Column:
    """An offline stand-in for an embedding: signed counts of words by hash, brought to length one (zero for no words). Built-in functions only."""
    placed = F.transform(words, lambda w: F.struct(F.pmod(F.crc32(w), F.lit(size)).cast("int").alias("at"), F.when(F.pmod(F.crc32(F.concat(w, F.lit("#"))), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")))
    count = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(placed, lambda p: p["at"] == i), F.lit(0.0), lambda s, p: s + p["sign"]))
    norm = F.sqrt(F.aggregate(count, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(count, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def topics_of(texts: DataFrame, terms: DataFrame, text_col: str, most: int = 7, block: int = 200_000) -> DataFrame:
    """texts with the topics whose terms (topic, term) occur in them, by the number of different terms found, then by name, at most so many. Upper and lower case are the same; empty and null terms are none.

    An Aho-Corasick automaton finds all terms in one pass over a text, whatever they are made of. Each task builds it; a block of at most about so many terms goes to the tasks at a time, and the blocks run one after the other over the same row, so no text is copied or shuffled."""
    rows = terms.select("topic", F.lower("term").alias("term")).filter("topic IS NOT NULL AND term <> ''").distinct()
    n = rows.count()
    blocks = 1 if n <= block else -(-2 * n // block)  # dealt by hash, half full on average
    found = F.array().cast(_TALLY)
    lower = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    for i in range(blocks if n else 0):
        own = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == i)
        by_term: dict[str, list[str]] = {}
        for r in own.collect():
            by_term.setdefault(r["term"], []).append(r["topic"])
        found = F.arrow_udf(_tally(by_term), _TALLY)(lower, found)
    ranked = F.array_sort(F.transform(found, lambda x: F.struct((-x.n).alias("n"), x.topic.alias("topic"))))
    return texts.withColumn("topics", F.transform(F.slice(ranked, 1, most), lambda x: x.topic))


_TALLY = "array<struct<topic:string,n:int>>"


def _tally(by_term: dict[str, list[str]]):
    """Adds the different terms found of each topic to those of the blocks before."""

    def each(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        automaton = ahocorasick.Automaton()
        for term, topics in by_term.items():
            automaton.add_word(term, (term, topics))
        automaton.make_automaton()
        kind = pa.list_(pa.struct([("topic", pa.string()), ("n", pa.int32())]))
        for texts, before in batches:
            out = []
            for text, had in zip(texts.to_pylist(), before.to_pylist(), strict=True):
                count = {x["topic"]: x["n"] for x in had}
                for topics in {term: topics for _, (term, topics) in automaton.iter(text)}.values():
                    for topic in topics:
                        count[topic] = count.get(topic, 0) + 1
                out.append([{"topic": t, "n": n} for t, n in count.items()])
            yield pa.array(out, kind)

    return each


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], dimension: int, text: str = "text", vector: str = "embedding", batch: int = 256, tries: int = 3, force: bool = False) -> DataFrame:
    """chunks with vectors from a client where they have none (or, with force, for all), batch texts a call, each call tried so often. Vectors of another dimension are an error."""
    ask = F.lit(True) if force else F.col(vector).isNull()

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            texts = array.to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None]
            out: list = [None] * len(texts)
            for i in range(0, len(at), batch):
                for left in reversed(range(tries)):
                    try:
                        got = embed([texts[j] for j in at[i : i + batch]])
                        break
                    except Exception:
                        if not left:
                            raise
                for j, v in zip(at[i : i + batch], got, strict=True):
                    if len(v) != dimension:
                        raise ValueError(f"a vector of {len(v)} numbers instead of {dimension}")
                    out[j] = v
            yield pa.array(out, pa.list_(pa.float32()))

    made = F.arrow_udf(each, "array<float>").asNondeterministic()(F.when(ask, F.coalesce(F.col(text), F.lit(""))))
    return chunks.withColumn("_made", made).withColumn(vector, F.coalesce("_made", F.col(vector).cast("array<float>"))).drop("_made")


def review_scores(reviews: DataFrame, category: str, correct: str) -> DataFrame:
    """Share of correct rows by category; systematic where three or more were reviewed and under half are right. Unreviewed rows (null) don't count."""
    per = reviews.filter(F.col(correct).isNotNull()).groupBy(category).agg(F.count("*").alias("n"), F.round(F.avg(F.col(correct).cast("int")), 6).alias("rate"))
    return per.withColumn("systematic", (F.col("n") >= 3) & (F.col("rate") < 0.5))


def judge_report(scores: DataFrame, slices: list[str], dimensions: list[str], passed: Column, extremes: bool = False) -> DataFrame:
    """Means (and extremes) of judge scores over rows that have them and the pass rate over all rows, in all and by each slice, in one aggregation; slice names which."""
    sets = scores.groupingSets([[], *([F.col(s)] for s in slices)], *(F.col(s) for s in slices))
    means = [F.round(F.avg(d), 6).alias(f"mean_{d}") for d in dimensions]
    ends = [f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))] if extremes else []
    return sets.agg(slice_name(slices).alias("slice"), F.count("*").alias("n"), F.round(F.avg(F.coalesce(passed, F.lit(False)).cast("int")), 6).alias("pass_rate"), *means, *ends)


def missed(expected: DataFrame, retrieved: DataFrame, question: str, item: str) -> DataFrame:
    """(item, n, questions): expected items that their question's results lack, how often, and all of those questions in order."""
    return missed_pairs(expected, retrieved, question, item).groupBy(item).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(question)).alias("questions"))


def missed_pairs(expected: DataFrame, retrieved: DataFrame, question: str, item: str) -> DataFrame:
    """(question, item) of expected items that their question's results lack; nothing is gathered."""
    return expected.select(question, item).distinct().join(retrieved.select(question, item), [question, item], "left_anti")
