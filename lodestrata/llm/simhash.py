"""SimHash near-duplicates through an inverted index over byte positions with count filtering.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at most BITS = 2 bits share at least six of them. Lists of single
bytes would each hold 1/256 of the corpus and their pairs would grow with its square, so the index keeps lists of four positional bytes: the 14 sets
of four positions out of eight that any three positions are in once (those whose numbers have an exclusive or of zero). Of these sets, three lie within
any six positions, one at most within five, none or one in four; so the hits of a pair in the lists tally its shared bytes: three or more mean six bytes
or more. Pairs with that guaranteed minimum of hits are kept, and the differing bits of what is left are counted.

Lists longer than LIST (large groups of near copies) are not paired. Their members are linked exactly by another way: two fingerprints differ in
at most two bits if and only if some value is within one bit of both, so each member names itself and its 64 one-bit neighbours, and members
that name the same value are linked to the least of them. No value can be named by more than 65 fingerprints. A pair that meets in such a list is
linked there if at all; for any other pair all lists in which it meets are tallied.

Copies have one fingerprint and enter the index once. Nulls: a null text is the empty text, with fingerprint zero, linked like any other; rows with
a null id get a fingerprint and the component of that fingerprint (null if no row of the component has an id). Repeated rows are each returned.

near_classes links texts whose sets of word shingles have a Jaccard similarity of so much, all such pairs and no others. Two sets that similar share
one of their first n - ceil(similarity * n) + 1 shingles in any order that is common to all, so lists of those alone miss no pair. The order is by
hash, with the FREQUENT most frequent shingles of a bounded sample last; it settles how long lists get and never what is found. The hits of a pair in the
lists are tallied here too: pairs with too few to be similar enough end there, as do, before that, those whose marks (a parity of hashes) differ in more
places than similar sets have elements to differ in: passages that many texts share make no pairs. SimHash links and the ends of each list are verified first; after that only members of a list that are not connected yet are paired, and each pair left is verified on the sets of both
texts, which are made anew from the texts: sets of 64-bit hashes take more room than the texts they are of, so none is written or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, drop_written, fresh, written
from .components import components

WORDS, BITS, LIST, BLOCK = 3, 2, 64, 1 << 15
SEED, SAMPLE, FREQUENT, FEW, MARKS = 42, 2_000, 20_000, 500_000, 256


def _hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a UTF-8 text in its order, in blocks; of a text with fewer words that of all of them. A-Z are lower-cased."""
    w = text.lower().split()
    if not w:
        return
    line, digest = b" ".join(w), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(w) - words + 1, 1)
    starts, ends = starts[:n].tolist(), ends[len(w) - n :].tolist()
    for i in range(0, n, BLOCK):
        yield np.array([digest(line[a:b], SEED) for a, b in zip(starts[i : i + BLOCK], ends[i : i + BLOCK], strict=True)], np.uint64)


def _majority(blocks: list[np.ndarray] | Iterator[np.ndarray]) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for h in blocks:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The signed 64-bit SimHash of a UTF-8 text. A-Z are lower-cased, shingles are hashed with XXH64."""
    return _majority(_hashes(text, words))


def _fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for array in texts:
        yield pa.array([fingerprint(t.as_py()) for t in pc.fill_null(array, "").cast(pa.binary())], pa.int64())


def simhash(text: Column | str) -> Column:
    return arrow_column(_fingerprints, "bigint", text)


def _set(text: bytes, words: int) -> np.ndarray:
    """The hashes of a text's shingles, each once, in order."""
    blocks = list(_hashes(text, words))
    return np.unique(np.concatenate(blocks)).view(np.int64) if blocks else np.zeros(0, np.int64)


def _least(sizes: np.ndarray | int, similarity: float):
    """The least that a set of so many shares with one that is similar enough."""
    return np.ceil(similarity * sizes - 1e-9).astype(int)


def _digests(words: int, similarity: float, frequent: np.ndarray):
    """Of each text: a name of its set of shingles, its SimHash, the size of the set, those shingles of which any similar set has one among its own, and marks:
    for each of MARKS remainders of a hash whether an odd number of the shingles has it. Marks of two sets differ in no more places than the sets have elements that the other lacks."""

    def each(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            names, prints, sizes, first, marks = [], [], [], [], []
            for t in pc.fill_null(array, "").cast(pa.binary()):
                blocks = list(_hashes(t.as_py(), words))
                h = np.unique(np.concatenate(blocks)).view(np.int64) if blocks else np.zeros(0, np.int64)
                late = np.isin(h, frequent)
                names.append(xxhash.xxh3_128_digest(h.tobytes()))
                prints.append(_majority(blocks))
                sizes.append(len(h))
                first.append(np.concatenate((h[~late], h[late]))[: len(h) - int(_least(np.int64(len(h)), similarity)) + 1])
                odd = np.bincount((h & (MARKS - 1)).astype(np.int64), minlength=MARKS) & 1
                marks.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
            columns = ((names, pa.binary()), (prints, pa.int64()), (sizes, pa.int32()), (first, pa.list_(pa.int64())), (marks, pa.list_(pa.int64())))
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in columns], ["class", "fp", "n", "first", "marks"])

    return each


def digests(text: Column | str, words: int, similarity: float, frequent: np.ndarray | None = None) -> Column:
    none = np.zeros(0, np.int64)
    return arrow_column(_digests(words, similarity, none if frequent is None else frequent), "struct<class:binary,fp:bigint,n:int,first:array<bigint>,marks:array<bigint>>", text)


def _shingles(words: int):
    def each(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            yield pa.array([_set(t.as_py(), words) for t in pc.fill_null(array, "").cast(pa.binary())], pa.list_(pa.int64()))

    return each


def _similar(words: int, similarity: float):
    """Whether two texts are similar enough. Rows come in order of the first text, so that its set is kept."""

    def each(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        text, own = None, np.zeros(0, np.int64)
        for left, right in pairs:
            out = []
            for a, b in zip(*(pc.fill_null(x, "").cast(pa.binary()).to_pylist() for x in (left, right)), strict=True):
                if a != text:
                    text, own = a, _set(a, words)
                other = _set(b, words)
                both = len(np.intersect1d(own, other, assume_unique=True))
                out.append(both >= similarity * (len(own) + len(other) - both) - 1e-9)
            yield pa.array(out, pa.bool_())

    return each


#: Sets of four of the eight positions, any three of which are in one set; FOUND of them lie within any six positions, and no more than one within five.
POSITIONS = [p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]
FOUND = 3


def _postings(prints: DataFrame) -> DataFrame:
    """(list, bytes, fp): each fingerprint under its lists of four positional bytes."""
    byte = lambda k: F.shiftrightunsigned(F.col("fp"), 8 * k).bitwiseAND(F.lit(255))
    four = lambda p: reduce(lambda x, k: F.shiftleft(x, 8).bitwiseOR(byte(k)), p[1:], byte(p[0]))
    return prints.select("fp", F.posexplode(F.array(*map(four, POSITIONS))).alias("list", "bytes"))


def links(prints: DataFrame) -> DataFrame:
    """(u, v) between distinct fingerprints (column fp) such that the components of these links are those of all pairs within BITS bits."""
    key = ["list", "bytes"]
    sizes = written(_postings(prints).groupBy(*key).count().filter("count > 1"), "lists")
    met = written(_postings(prints).join(sizes, key), "postings")
    drop_written(sizes)
    short = met.filter(F.col("count") <= LIST)
    hits = short.select(*key, F.col("fp").alias("u")).join(short.select(*key, F.col("fp").alias("v")), key).filter("u < v")
    tallied = hits.groupBy("u", "v").agg(F.count("*").alias("hits")).filter(F.col("hits") >= FOUND)
    pairs = tallied.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= BITS).select("u", "v")
    crowd = met.filter(F.col("count") > LIST).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)))
    named = crowd.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("value"))
    least = named.groupBy("value").agg(F.min("fp").alias("u"), F.max("fp").alias("most")).filter("u < most").drop("most")
    stars = named.join(least, "value").filter("u < fp").select("u", F.col("fp").alias("v"))
    return pairs.unionByName(stars).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row of docs; component_id is the smallest id that links reach."""
    prints = written(docs.select(F.col(id_col).alias("id"), simhash(text_col).alias("fp")), "fingerprints")
    each = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    reached = written(components(links(each)), "components")
    named = each.join(reached, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    return prints.join(written(named.select("fp", "root").join(roots, "root").select("fp", "component_id"), "classes"), "fp")


def _of(sets: DataFrame, rows: DataFrame, how: str = "left_semi") -> DataFrame:
    """The sets of some rows, or without them; up to FEW rows are sent to the sets, which then stay where they are."""
    few = rows.limit(FEW + 1).count() <= FEW
    return sets.join(F.broadcast(rows) if few else rows, rows.columns, how)


def _alike(pairs: DataFrame, sets: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those pairs (u, v) whose texts are similar enough."""
    nodes = written(pairs.select(F.col("u").alias("row")).unionByName(pairs.select(F.col("v").alias("row"))).distinct(), "nodes")
    few = _of(sets.select("row", "text"), nodes)
    side = lambda end, name: few.select(F.col("row").alias(end), F.col("text").alias(name))
    both = pairs.join(side("v", "b"), "v").join(side("u", "a").hint("merge"), "u")
    return both.select("u", "v", arrow_column(_similar(words, similarity), "boolean", "a", "b").alias("alike")).filter("alike").select("u", "v")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _near_prints(sets: DataFrame) -> DataFrame:
    """(u, v) of sets whose fingerprints are equal or linked, each fingerprint by its least set."""
    least = written(sets.groupBy("fp").agg(F.min("row").alias("least")), "least")
    same = sets.select("fp", "row").join(least, "fp").select(*_pair("row", "least"))
    ends = links(least.select("fp")).join(least.select(F.col("fp").alias("u"), F.col("least").alias("a")), "u").join(least.select(F.col("fp").alias("v"), F.col("least").alias("b")), "v")
    return same.unionByName(ends.select(*_pair("a", "b")))


def _frequent(texts: DataFrame, words: int) -> np.ndarray:
    """Hashes of the shingles that most texts of a sample of about SAMPLE rows have; FREQUENT at most. Rows are chosen by id and text, so copies of a text come in in proportion, however many they are."""
    share = max(1, texts.count() // SAMPLE)
    sample = texts.filter(F.pmod(F.xxhash64("id", "text"), F.lit(share)) == 0).select(F.explode(arrow_column(_shingles(words), "array<bigint>", "text")).alias("key"))
    top = sample.groupBy("key").count().filter("count >= 4").orderBy(F.desc("count"), "key").limit(FREQUENT).collect()
    return np.array([r["key"] for r in top], np.int64)


def _enough(similarity: float) -> Column:
    """Whether two sets of n_u and n_v shingles can be similar enough if their first ones have hits in common: what one of them has beyond its first is all that they can share besides."""
    shared = similarity / (1 + similarity) * (F.col("n_u") + F.col("n_v"))
    rest = F.greatest(*(F.ceil(similarity * F.col(n) - 1e-9) - 1 for n in ("n_u", "n_v")))
    return (F.col("hits") + rest >= shared - 1e-6) & (F.least("n_u", "n_v") >= similarity * F.greatest("n_u", "n_v") - 1e-9)


def similar(sets: DataFrame, words: int, similarity: float) -> DataFrame:
    """(u, v) between sets (row, fp, n, first, text) such that the components of these links are those of all pairs that are similar enough."""
    postings = sets.select("row", "n", F.explode("first").alias("key"))
    shared = written(postings.groupBy("key").count().filter("count > 1").select("key"), "lists")
    met = written(postings.join(shared, "key"), "met")
    steps = met.withColumn("step", F.floor(F.log("n") / F.log(F.lit(1.1))))  # so many sizes that any two are alike enough
    own = F.struct("row", "n")
    heads = steps.groupBy("key", "step").agg(F.min(own).alias("low"), F.max(own).alias("high"))
    ends = steps.join(heads, ["key", "step"]).select("row", "n", F.explode(F.array_distinct(F.array("low", "high"))).alias("head")).filter("row <> head.row")
    stars = ends.select(*_pair("row", "head.row"), F.col("n").alias("n_u"), F.col("head.n").alias("n_v")).groupBy("u", "v", F.least("n_u", "n_v").alias("n_u"), F.greatest("n_u", "n_v").alias("n_v")).agg(F.count("*").alias("hits"))
    easy = written(stars.filter(_enough(similarity)).select("u", "v").unionByName(_near_prints(sets)).filter("u <> v").distinct(), "pairs")
    linked = written(_alike(easy, sets, words, similarity), "links")
    reached = written(components(linked), "components")
    placed = written(met.join(reached, F.col("row") == F.col("node"), "left").select("key", "row", "n", F.coalesce("component", "row").alias("root")), "placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    named = [F.get("marks", F.lit(i)).alias(f"m{i}") for i in range(MARKS // 64)]
    rest = written(placed.join(mixed, "key").join(sets.select("row", *named), "row"), "rest")
    for table in (shared, met, placed):
        drop_written(table)
    side = lambda end: rest.select("key", *(F.col(c).alias(f"{c}_{end}") for c in rest.columns if c != "key")).withColumnRenamed(f"row_{end}", end)
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"m{i}_u").bitwiseXOR(F.col(f"m{i}_v"))) for i in range(MARKS // 64)))
    close = apart <= (1 - similarity) / (1 + similarity) * (F.col("n_u") + F.col("n_v")) + 1e-6
    pairs = side("u").join(side("v"), "key").filter((F.col("u") < F.col("v")) & (F.col("root_u") != F.col("root_v")) & close).groupBy("u", "v", "n_u", "n_v").agg(F.count("*").alias("hits"))
    hard = written(pairs.filter(_enough(similarity)).select("u", "v").join(easy, ["u", "v"], "left_anti"), "pairs")
    return linked.unionByName(_alike(hard, sets, words, similarity))


def near_classes(docs: DataFrame, words: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) as classes has them, with links between similar sets of shingles; fp names the set."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = texts.select("id", "text", digests("text", words, similarity, _frequent(texts, words)).alias("made"))
    prints = written(made.select("id", "text", "made.*").withColumn("row", F.monotonically_increasing_id()), "digests", "zstd")
    each = written(prints.groupBy("class").agg(F.min("id").alias("least"), F.min("row").alias("row")), "distinct")
    reached = written(components(similar(_of(prints.drop("id", "class"), each.select("row")), words, similarity)), "components")
    named = each.join(reached, F.col("row") == F.col("node"), "left").select("class", "least", F.coalesce("component", "row").alias("root"))
    roots = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    found = prints.select("id", "class").join(named.join(roots, "root").select("class", "component_id"), "class")
    out = written(found.select("id", F.col("class").alias("fp"), "component_id"), "classes")
    drop_written(prints)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float | None = None) -> DataFrame:
    """docs with one row of each component: that with the smallest id, of repeated rows with that id one. Rows without an id all stay.

    Without a similarity links are between fingerprints of WORDS words within BITS bits, with one between sets of shingles of so many words."""
    if similarity is None and words != WORDS:
        raise ValueError("words needs a similarity")
    near = similarity is not None
    found = near_classes(docs, words, similarity, id_col, text_col) if near else written(classes(docs, id_col, text_col), "classes")
    gone = written(found.filter("id <> component_id").select(F.col("id").alias(id_col)).distinct(), "gone")
    stay = _of(docs.filter(F.col(id_col).isNotNull()), gone, "left_anti")
    if not found.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").isEmpty():
        name = digests(text_col, words, similarity).getField("class") if near else simhash(text_col)
        stay = _one_each(docs.filter(F.col(id_col).isNotNull()), found, id_col, name)
    return stay.unionByName(docs.filter(F.col(id_col).isNull()))


def _one_each(stay: DataFrame, found: DataFrame, id_col: str, print_of: Column) -> DataFrame:
    """Where ids repeat: one row for each id whose fingerprint is that of a kept row."""
    (fp,) = fresh(stay, "fp")
    right = found.filter(F.col("id") == F.col("component_id")).select(F.col("id").alias(id_col), F.col("fp").alias(fp)).distinct()
    return stay.withColumn(fp, print_of).join(right, [id_col, fp], "left_semi").dropDuplicates([id_col]).drop(fp)
