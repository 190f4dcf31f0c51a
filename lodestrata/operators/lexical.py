"""Lexical search over an index of postings: English stems, positions, BM25 by blocks with bounds, and cover density.

The index is three tables. postings: one row for each term and block of documents, with the documents' ids, counts, lengths and positions of the term, and top, the greatest share of a
score that any of them can have; documents are dealt to blocks of about BLOCK by a hash of their id, and rows lie in folders by a bucket of the term. terms: how many documents have a term. stats: documents and mean
length. A query reads the buckets of its terms and of those only the rows of its terms.

Search first looks at terms, blocks and tops alone. A block can give a query no more than the sum of its terms' tops; the greatest single top of a block is reached by one document of it, so the k-th greatest of those
over the blocks is a score that k documents have. Blocks below it are left out, and only the postings of the others are read, joined and added up. Nothing is sampled or capped: the k best are exact.

Lexemes are runs of letters and digits of ASCII in lower case; with stems, words of the stop list go and the others are cut by the algorithm of Porter (1980). Positions count all words, stop words too.
Nulls: a null text has no words; rows with a null id or qid have no part. Repeated ids are documents of their own with one name, whose scores are added. Ids are of any type with an order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stored import stored

K1, B, BLOCK, BUCKETS = 1.2, 0.75, 128, 64
#: Terms of queries that go to all tasks, of a few bytes each; more of them are joined by a shuffle.
FEW = 100_000
#: English words that full-text search leaves out.
STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was "
    "were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over "
    "under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
# Endings of Porter's algorithm (1980) and what takes their place, in the order in which they are tried.
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"
_C, _V = "(?:[^aeiou][^aeiouy]*)", "(?:[aeiouy][aeiou]*)"
#: Conditions on what stands before an ending: one or more, exactly one, two or more sequences of vowels and consonants; a vowel; consonant, vowel and a consonant other than w, x, y at the end.
M0, M_ONE, M1 = f"^{_C}?{_V}{_C}", f"^{_C}?{_V}{_C}{_V}?$", f"^{_C}?{_V}{_C}{_V}{_C}"
HAS_VOWEL, SHORT = f"^{_C}?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"


def _ends(table: str, condition: str) -> list[tuple[str, str, str]]:
    """(ending, conditions on the stem, parted by a space, what takes its place); longer endings first, as only the longest that fits is tried."""
    pairs = [(e.split(":") + [""])[:2] for e in table.split()]
    return sorted(((e, condition, to) for e, to in pairs), key=lambda x: -len(x[0]))


def _step(word: str, rules: list[tuple[str, str, str]]) -> str:
    for ending, condition, to in rules:
        if word.endswith(ending):
            stem = word[: len(word) - len(ending)]
            return stem + to if all(re.search(c, stem) for c in condition.split(" ")) else word
    return word


_RULES_2, _RULES_3, _RULES_4 = _ends(STEP_2, M0), _ends(STEP_3, M0), sorted([*_ends(STEP_4, M1), ("ion", f"{M1} [st]$", "")], key=lambda x: -len(x[0]))


@lru_cache(1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    # 1a to 1c: plurals, -ed and -ing, y after a vowel.
    word = _step(word, [("sses", "", "ss"), ("ies", "", "i"), ("ss", "", "ss"), ("s", "", "")])
    if word.endswith("eed"):
        word = _step(word, [("eed", M0, "ee")])
    else:
        cut = _step(word, [("ing", HAS_VOWEL, ""), ("ed", HAS_VOWEL, "")])
        if cut != word:
            word = cut
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif re.search(r"([^aeiouylsz])\1$", word):
                word = word[:-1]
            elif re.search(SHORT, word):
                word += "e"
    word = _step(word, [("y", HAS_VOWEL, "i")])
    for rules in (_RULES_2, _RULES_3, _RULES_4):
        word = _step(word, rules)
    # 5: a last e and a doubled l.
    if word.endswith("e") and (re.search(M1, word[:-1]) or (re.search(M_ONE, word[:-1]) and not re.search(SHORT, word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and re.search(M1, word) else word


_WORD = re.compile("[a-z0-9]+")


def _postings(stemmed: bool):
    stop = frozenset(STOP) if stemmed else frozenset()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, terms, lengths, places = [], [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                words = _WORD.findall(text)
                own: dict[str, list[int]] = {}
                for at, w in enumerate(words):
                    if w not in stop:
                        own.setdefault(stem(w) if stemmed else w, []).append(at)
                rows += [i] * (len(own) + 1)
                terms += [None, *own]  # a row without a term: the document itself
                lengths += [sum(map(len, own.values()))] * (len(own) + 1)
                places += [None, *own.values()]
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(rows, pa.int64())), pa.array(terms, pa.string()), pa.array(lengths, pa.int32()), pa.array(places, pa.list_(pa.int32()))], ["id", "term", "length", "positions"])

    return each


def occurrences(texts: DataFrame, stemmed: bool = True) -> DataFrame:
    """texts (id, text): (id, term, length, positions), one row for each term of a text, and one without a term for the text itself. length: the terms of the text, repeats included."""
    rows = texts.filter("id IS NOT NULL").select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return rows.mapInArrow(_postings(stemmed), f"id {texts.schema['id'].dataType.simpleString()}, term string, length int, positions array<int>")


@dataclass
class Index:
    postings: DataFrame
    terms: DataFrame
    n: int
    mean: float
    stemmed: bool
    buckets: int


def _share(tf: Column, length: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.crc32("term"), F.lit(buckets)).cast("int")


def _lengths(stemmed: bool):
    """Of each batch its number of texts and of their terms, repeats included."""
    stop = frozenset(STOP) if stemmed else frozenset()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(sum(w not in stop for w in _WORD.findall(t.as_py())) for t in batch["text"])
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64()), "words": pa.array([n], pa.int64())})

    return each


def _by_block(stemmed: bool, mean: float, most: int):
    """Texts in order of block and id to postings by term and block. A block of very many texts, which repeated ids make, gives a term more than one row."""
    stop = frozenset(STOP) if stemmed else frozenset()

    def postings(block: int, ids: list[pa.Array], lengths: list[int], held: dict[str, list[tuple[int, list[int]]]]) -> pa.RecordBatch:
        entries = [e for x in held.values() for e in x]
        doc = np.array([d for d, _ in entries], np.int64)
        tf, length = np.array([len(p) for _, p in entries], np.int32), np.array(lengths, np.int32)[doc]
        n = np.array([len(x) for x in held.values()], np.int32)
        starts, offsets = np.cumsum(n) - n, pa.array(np.r_[0, np.cumsum(n)], pa.int32())
        top = np.maximum.reduceat(tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)), starts)
        places = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(tf)], pa.int32()), pa.array(np.concatenate([p for _, p in entries]), pa.int32()))
        lists = [pa.ListArray.from_arrays(offsets, v) for v in (pa.concat_arrays(ids).take(pa.array(doc)), pa.array(tf), pa.array(length), places)]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(np.full(len(n), block), pa.int64()), pa.array(top), pa.array(n), *lists], ["term", "block", "top", "n", "ids", "tfs", "lengths", "positions"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, lengths, held = None, [], [], {}
        for batch in batches:
            for i, (block, text) in enumerate(zip(batch["block"].to_pylist(), batch["text"], strict=True)):
                if block != now or len(lengths) >= most:
                    if held:
                        yield postings(now, ids, lengths, held)
                    now, ids, lengths, held = block, [], [], {}
                own: dict[str, list[int]] = {}
                for at, w in enumerate(_WORD.findall(text.as_py())):
                    if w not in stop:
                        own.setdefault(stem(w) if stemmed else w, []).append(at)
                for term, places in own.items():
                    held.setdefault(term, []).append((len(lengths), places))
                ids.append(batch["id"].slice(i, 1))
                lengths.append(sum(map(len, own.values())))
        if held:
            yield postings(now, ids, lengths, held)

    return each


def _tables(docs: DataFrame, stemmed: bool, only: DataFrame | None, buckets: int, block: int) -> tuple[DataFrame, int, float]:
    """Texts are shuffled by block, and each block makes its postings in one task: no row for each term and document is written or shuffled. Texts are read once before, for their mean length."""
    rows = docs.filter("id IS NOT NULL").select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    n, words = rows.select("text").mapInArrow(_lengths(stemmed), "n bigint, words bigint").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    mean, blocks = float(words / n if words else 1.0), max(1, -(-n // block))
    kind = docs.schema["id"].dataType.simpleString()
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "text").repartition("block").sortWithinPartitions("block", "id")
    postings = dealt.mapInArrow(_by_block(stemmed, mean, 8 * block), f"term string, block bigint, top double, n int, ids array<{kind}>, tfs array<int>, lengths array<int>, positions array<array<int>>")
    if only is not None:
        postings = postings.join(_few(only.distinct(), only.count()), "term", "left_semi")
    return postings.withColumn("bucket", _bucket(buckets)), n, mean


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df with a hint to broadcast it where it has no more than so many rows as are known to be few."""
    return F.broadcast(df) if rows <= FEW else df


def _terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.sum("n").alias("df"))


def build(docs: DataFrame, stemmed: bool = True, only: DataFrame | None = None, block: int = BLOCK) -> Index:
    """An index of docs (id, text) for this session, of all terms or of those of only (term)."""
    postings, n, mean = _tables(docs, stemmed, only, 1, block)
    postings = stored(postings)
    return Index(postings, _terms(postings), n, mean, stemmed, 1)


def write_index(docs: DataFrame, path: str, stemmed: bool = True, buckets: int = BUCKETS, block: int = BLOCK) -> None:
    """The index of docs (id, text) written to a folder, once for all searches. One shuffle by term and block, one by bucket; a frequent term is parted over its blocks."""
    postings, n, mean = _tables(docs, stemmed, None, buckets, block)
    postings.repartition("bucket", F.pmod("block", F.lit(8))).sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    _terms(docs.sparkSession.read.parquet(f"{path}/postings")).withColumn("bucket", _bucket(buckets)).repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    docs.sparkSession.createDataFrame([(n, mean, stemmed, buckets)], "n long, mean double, stemmed boolean, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def read_index(spark: SparkSession, path: str) -> Index:
    s = spark.read.parquet(f"{path}/stats").first()
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), s["n"], s["mean"], s["stemmed"], s["buckets"])


def query_terms(queries: DataFrame, stemmed: bool = True) -> DataFrame:
    """queries (qid, text): (qid, term, terms), the different terms of each and how many they are."""
    rows = occurrences(queries.filter("qid IS NOT NULL").select(F.col("qid").alias("id"), "text"), stemmed).filter("term IS NOT NULL").select(F.col("id").alias("qid"), "term").distinct()
    return rows.withColumn("terms", F.count("*").over(Window.partitionBy("qid")))


def search(index: Index, queries: DataFrame, k: int, by: str = "bm25") -> DataFrame:
    """queries (qid, text): (qid, id, score, matched, terms, occurrences, rank, density), the k best of each query by values rounded to six digits, ties by id; rank is by score.

    by: bm25, or share (of the query's terms found); score is BM25 in both. matched: different terms found; occurrences: how often in all; density: cover_density of their places."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    own, wanted = _asked(index, stored(query_terms(queries, index.stemmed)))
    found = _positions(_best(index, own, wanted, k, by), own, wanted)
    return found.withColumn("rank", F.row_number().over(w)).withColumn("density", F.round(_density("positions"), 6)).drop("positions")


def _asked(index: Index, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of asked (qid, term, terms) the postings of its terms, and (qid, term, terms, idf) of the terms that there are."""
    postings, known, n = index.postings, index.terms, asked.count()
    if index.buckets > 1:
        used = [r["bucket"] for r in asked.select(_bucket(index.buckets).alias("bucket")).distinct().collect()]  # as many as there are buckets at most
        postings, known = postings.filter(F.col("bucket").isin(used)), known.filter(F.col("bucket").isin(used))
    idf = F.log(1 + (F.lit(float(index.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    wanted = stored(known.join(_few(asked, n), "term").select("qid", "term", "terms", idf.alias("idf")))
    return postings.join(_few(wanted.select("term").distinct(), n), "term", "left_semi"), _few(wanted, n)


def _best(index: Index, own: DataFrame, wanted: DataFrame, k: int, by: str) -> DataFrame:
    """(qid, id, score, matched, terms, occurrences), the k best of each query by bm25, or by the share of its terms that are found."""
    part = (F.col("idf") * F.col("top")) if by == "bm25" else (1 / F.col("terms"))
    bounds = stored(own.select("term", "block", "top").repartition("block").join(wanted, "term").groupBy("qid", "block").agg(F.sum(part).alias("most"), F.max(part).alias("sure")))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sure")))
    least = bounds.withColumn("place", place).filter(F.col("place") <= k).groupBy("qid").agg(F.min("sure").alias("least"), F.count("*").alias("blocks"))
    kept = bounds.join(least, "qid").filter((F.col("blocks") < k) | (F.col("most") >= F.col("least") - 1e-5)).select("qid", "block")
    kept = stored(kept)
    hits = own.select("term", "block", "ids", "tfs", "lengths").repartition("block").join(wanted, "term").join(_few(kept, kept.count()), ["qid", "block"])  # a block's postings lie in one task, so what is added up there isn't shuffled
    each = F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("e")
    rows = hits.select("qid", "block", "terms", "idf", each).select("qid", "block", "terms", "idf", F.col("e.ids").alias("id"), F.col("e.tfs").alias("tf"), F.col("e.lengths").alias("length"))
    score = F.round(F.sum(F.col("idf") * _share(F.col("tf").cast("double"), F.col("length"), index.mean)), 6)
    found = rows.groupBy("qid", "block", "id").agg(score.alias("score"), F.count("*").alias("matched"), F.first("terms").alias("terms"), F.sum("tf").alias("occurrences"))
    key = F.desc("score") if by == "bm25" else F.desc(F.round(F.col("matched") / F.col("terms"), 6))
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy(key, "id"))).filter(F.col("_r") <= k).drop("_r", "block")


def _positions(found: DataFrame, own: DataFrame, wanted: DataFrame) -> DataFrame:
    """found (qid, id and others) with positions, a list of places for each term found. Postings are read once more, for the best alone, which go to all tasks where they are few."""
    best = stored(found)
    pairs = best.select("qid", "id").join(wanted.select("qid", "term"), "qid")
    places = own.select("term", F.explode(F.arrays_zip("ids", "positions")).alias("e")).select("term", F.col("e.ids").alias("id"), F.col("e.positions").alias("places"))
    met = places.join(_few(pairs, pairs.count()), ["term", "id"])
    return best.join(met.groupBy("qid", "id").agg(F.collect_list("places").alias("positions")), ["qid", "id"])


def cover_density(lists: list[list[int]]) -> float:
    """Of the places of different terms: the sum over all shortest spans that hold every one of them of the number of terms over the span's length (Clarke, Cormack and Tudhope)."""
    spots = sorted((p, t) for t, places in enumerate(lists) for p in places)
    last: dict[int, int] = {}
    total, before = 0.0, -1
    for p, t in spots:
        last[t] = p
        if len(last) == len(lists):
            low = min(last.values())
            if low > before:  # else the span holds an earlier one
                total += len(lists) / (p - low + 1)
                before = low
    return total


def _density(positions: str) -> Column:
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            yield pa.array([cover_density(x) for x in array.to_pylist()], pa.float64())

    return F.arrow_udf(each, "double")(positions)
