"""Rankings: exact and cell-wise vector search, lexical search, fusion, reranking, and metrics of rankings.

A ranking is a table (qid, id, rank, score), rank from 1. Queries are a set that the caller states; it is broadcast only where it has at most
BROADCAST rows and is joined by key otherwise, except for exact vector search, which goes over the corpus once for each block of queries.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexical import K1, B
from .stored import stored

#: Rows of a side that may be broadcast, by count.
BROADCAST = 10_000
#: Scores that a task makes at once, and rows that it keeps at most before it hands them on.
CELLS, KEPT = 1 << 19, 1 << 21


def small(df: DataFrame, rows: int = BROADCAST) -> DataFrame:
    """df with a hint to broadcast it if it has at most so many rows; at most rows + 1 are counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def top(scored: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best of each query by score, ties by id. Spark keeps k rows a query and task before it shuffles (WindowGroupLimit)."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, facet: str | None = None) -> DataFrame:
    """queries (qid, qvec), corpus (id, vec): the k most similar vectors of other ids; a null vector has similarity 0 to all. Ids are of any type that has an order, the same in the result; rows with a null qid or id have no part.

    facet: both have a column of that name, and only pairs that agree in it count, null with null. Each block of at most about BROADCAST queries becomes
    a matrix that each task multiplies with its own rows, of which it keeps the k best.
    """
    return top(_best_by_block(queries, corpus, k, facet, True).select("qid", "id", "score"), k)


def vector_topk_by_facet(queries: DataFrame, corpus: DataFrame, k: int, facet: str, scope: DataFrame | None = None, scope_by: str | None = None) -> DataFrame:
    """(qid, id, facet, score, rank): the k best of each query in each facet of the corpus.

    scope (qid, and a column called scope_by, by default facet): the values of the corpus's column scope_by in which a query looks at all; they travel with the query, and no other pair is scored. All rows of a facet have one value of scope_by."""
    w = Window.partitionBy("qid", "facet").orderBy(F.desc("score"), "id")
    if scope is not None:
        by = scope_by or facet
        own = scope.filter(F.col(by).isNotNull()).groupBy("qid").agg(F.collect_set(F.col(by).cast("string")).alias("_scope"))
        queries, corpus = queries.join(own, "qid"), corpus.withColumn("_scope", F.col(by).cast("string"))
    best = _best_by_block(queries, corpus, k, facet, False).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.withColumnRenamed("facet", facet) if facet != "facet" else best


def _best_by_block(queries: DataFrame, corpus: DataFrame, k: int, facet: str | None, same: bool) -> DataFrame:
    """The k best of each task and query. Blocks are dealt by hash and half full on average, as their sizes vary. Of several blocks each is written before the next is read, so the driver holds one at a time."""
    queries = queries.filter("qid IS NOT NULL")
    n = queries.count()
    if n <= BROADCAST:
        return _best_by_task(queries, corpus, k, facet, same)
    blocks = -(-2 * n // max(1, BROADCAST))
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [stored(_best_by_task(queries.filter(block == i), corpus, k, facet, same)) for i in range(blocks)])


def _matrix(vectors: pa.Array, size: int | None = None) -> np.ndarray:
    """Vectors of length one as rows; those that are null or have no length are zero. Nulls inside a vector count 0. Vectors of another size than the first (or than size) are an error."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    size = int(sizes.max(initial=0)) if size is None else size
    m = np.zeros((len(vectors), size))
    there = sizes > 0
    if ((sizes != size) & there & (size > 0)).any():
        raise ValueError(f"a vector of {sizes[(sizes != size) & there][0]} numbers among vectors of {size}")
    if there.any() and size:
        m[there] = np.nan_to_num(pc.fill_null(pc.list_flatten(vectors).cast(pa.float64()), 0).to_numpy(zero_copy_only=False).reshape(-1, size))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _best_by_task(queries: DataFrame, corpus: DataFrame, k: int, facet: str | None, same: bool) -> DataFrame:
    label = F.coalesce(F.concat(F.lit("="), F.col(facet).cast("string")), F.lit("")) if facet else F.lit("")  # null is no text
    scoped = "_scope" in queries.columns
    asked = queries.select("qid", "qvec", (label if same else F.lit("")).alias("facet"), *(["_scope"] if scoped else [])).toArrow().combine_chunks()
    qids, q = asked["qid"].combine_chunks(), _matrix(asked["qvec"])
    columns_of: dict[str, list[int]] = {}  # by facet or scope: the queries that look there
    if scoped or facet and same:
        for i, own in enumerate(asked["_scope" if scoped else "facet"].to_pylist()):
            for f in own if scoped else [own]:
                columns_of.setdefault(f, []).append(i)
    places: dict[object, list[int]] = {}  # by id: the queries that have it
    for i, v in enumerate(qids.to_pylist()):
        places.setdefault(v, []).append(i)
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((queries, "qid"), (corpus, "id"))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[object, _Running] = {}  # by facet: the best rows of the task so far

        def found() -> Iterator[pa.RecordBatch]:
            for f, b in best.items():
                for columns, scores, ids, _ in b.parts():
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(columns)), ids, pa.array([f] * len(ids), pa.string()), pa.array(scores)], ["qid", "id", "facet", "score"])
            best.clear()

        every = np.arange(len(qids))
        for batch in batches:
            part = batch.sort_by([("facet", "ascending"), ("id", "ascending")])
            facets = part["facet"].to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, facets[1:] != facets[:-1]]) if len(facets) else []
            for a, b in zip(starts, [*starts[1:], len(facets)], strict=True):
                columns = np.array(columns_of.get(part["_scope" if scoped else "facet"][a].as_py(), []), np.int64) if columns_of or scoped else every
                if not len(columns):
                    continue
                own_q = q if columns is every else q[columns]
                kept = best.setdefault(facets[a], _Running(k))
                step = max(1, CELLS // len(columns))
                for i in range(a, b, step):
                    rows = part.slice(i, min(step, b - i))
                    scores = np.round(_matrix(rows["vec"], q.shape[1]) @ own_q.T, 6) if q.shape[1] else np.zeros((len(rows), len(columns)))
                    for row, v in enumerate(rows["id"].to_pylist()):
                        if v in places:
                            scores[row, np.isin(columns, places[v])] = -np.inf
                    kept.add(columns, scores, rows["id"], ())
            if sum(len(b) for b in best.values()) > KEPT:
                yield from found()
        yield from found()

    rows = corpus.filter("id IS NOT NULL").select("id", "vec", label.alias("facet"), *(["_scope"] if scoped else []))
    if not len(qids):
        return rows.limit(0).selectExpr(f"CAST(NULL AS {kinds[0]}) AS qid", "id", "facet", "0.0D AS score")
    return rows.mapInArrow(each, f"qid {kinds[0]}, id {kinds[1]}, facet string, score double").withColumn("facet", F.when(F.col("facet") != "", F.substr("facet", F.lit(2))))


class _Running:
    """The k best rows of each column that a task has seen, with their ids and other values; of equal scores the smallest ids. Candidates gather until there are more of them than of kept rows; then the best of both stay, and what is worse than
    the k-th of a column isn't gathered any more. So a task holds, and hands on, k rows a column, however many it reads."""

    def __init__(self, k: int) -> None:
        self.k, self.least, self.new, self.waiting = k, np.zeros(0), [], 0
        self.columns, self.scores, self.ids, self.more = np.zeros(0, np.int64), np.zeros(0), None, []

    def __len__(self) -> int:
        return len(self.columns) + self.waiting

    def add(self, columns: np.ndarray, scores: np.ndarray, ids: pa.Array, more: tuple[np.ndarray, ...]) -> None:
        """scores: a row for each of ids, which are in order, and a column for each of columns, which ascend; -inf is no row. more: other tables of that form."""
        if not scores.size:
            return
        if len(self.least) <= columns[-1]:
            self.least = np.r_[self.least, np.full(columns[-1] + 1 - len(self.least), -np.inf)]
        r, c = np.nonzero((scores >= self.least[columns]) & (scores > -np.inf))
        if len(r) > self.k * len(columns):
            r, c = _best(scores, self.k)
        if len(r):
            self.new.append((columns[c], scores[r, c], ids.take(pa.array(r)), [m[r, c] for m in more]))
            self.waiting += len(r)
        if self.waiting > max(1 << 15, len(self.columns)):
            self.merge()

    def merge(self) -> None:
        if not self.new:
            return
        old = [] if self.ids is None else [(self.columns, self.scores, self.ids, self.more)]
        columns, scores = (np.concatenate([x[i] for x in (*old, *self.new)]) for i in (0, 1))
        ids = pa.concat_arrays([x[2] for x in (*old, *self.new)])
        more = [np.concatenate(x) for x in zip(*(x[3] for x in (*old, *self.new)), strict=True)]
        rank = np.empty(len(ids), np.int64)
        rank[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
        order = np.lexsort((rank, -scores, columns))
        place = np.arange(len(order)) - np.searchsorted(columns[order], columns[order])  # within its column
        last = order[place == self.k - 1]
        order = order[place < self.k]
        self.least[columns[last]] = scores[last]
        self.columns, self.scores, self.ids, self.more = columns[order], scores[order], ids.take(pa.array(order)), [m[order] for m in more]
        self.new, self.waiting = [], 0

    def parts(self, n: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, list[np.ndarray]]]:
        """Columns, scores, ids and other values of what is kept, so many rows at a time."""
        self.merge()
        for i in range(0, len(self.columns), n):
            yield self.columns[i : i + n], self.scores[i : i + n], self.ids.slice(i, n), [m[i : i + n] for m in self.more]


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of each column; of equal scores the first rows."""
    s = np.ascontiguousarray(scores.T)
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] if s.shape[1] > k else np.full((len(s), 1), -np.inf)
    c, r = np.nonzero(np.isfinite(s) & (s >= least))
    order = np.lexsort((r, -s[c, r], c))
    c, r = c[order], r[order]
    kept = np.arange(len(c)) - np.searchsorted(c, c) < k  # by the place within its column
    return r[kept], c[kept]


def fit_cells(corpus: DataFrame, cells: int, sample: int = 20_000, seed: int = 42) -> list[list[float]]:
    """Centres of cells by k-means on a bounded sample: the vectors of the smallest hashes of ids, without those that are null."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = corpus.filter("vec IS NOT NULL").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    return [c.tolist() for c in KMeans(k=cells, seed=seed, maxIter=10).fit(rows).clusterCenters()]


def nearest_cells(vec: str, centres: list[list[float]], n: int) -> Column:
    """Numbers of the n centres nearest to a vector brought to length one, nearest first. The centres are of bounded number; a matrix of them goes to each task."""
    c = np.array(centres, float)

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            away = (c * c).sum(1) - 2 * _matrix(array, c.shape[1]) @ c.T
            found = np.argsort(away, axis=1, kind="stable")[:, :n].astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))

    return F.arrow_udf(each, "array<int>")(F.col(vec))


def cell_topk(queries: DataFrame, corpus: DataFrame, k: int, centres: list[list[float]], probes: int) -> DataFrame:
    """vector_topk among the vectors of the probes cells nearest to each query. Every vector is indexed, under its own nearest cell; the cells of a query travel with it."""
    indexed = corpus.filter("id IS NOT NULL").withColumn("cell", nearest_cells("vec", centres, 1)[0])
    return _in_cells(queries, indexed, k, centres, probes)


def _in_cells(queries: DataFrame, indexed: DataFrame, k: int, centres: list[list[float]], probes: int) -> DataFrame:
    scope = queries.select("qid", F.explode(nearest_cells("qvec", centres, probes)).alias("cell"))
    return top(vector_topk_by_facet(queries, indexed, k, "cell", scope).select("qid", "id", "score"), k)


def write_cells(corpus: DataFrame, path: str, cells: int, sample: int = 20_000) -> None:
    """The index of corpus (id, vec) written to a folder: every vector in a folder of its cell, and the centres. One shuffle by cell; a cell that holds very many vectors is parted over files."""
    centres = fit_cells(corpus, cells, sample)
    rows = corpus.filter("id IS NOT NULL").withColumn("cell", nearest_cells("vec", centres, 1)[0])
    rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    table = corpus.sparkSession.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def search_cells(path: str, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """cell_topk over a written index; only folders of cells that some query probes are read."""
    spark = queries.sparkSession
    centres = [r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()]
    used = [r["cell"] for r in queries.filter("qid IS NOT NULL").select(F.explode(nearest_cells("qvec", centres, probes)).alias("cell")).distinct().collect()]  # as many as there are cells at most
    return _in_cells(queries, spark.read.parquet(f"{path}/vectors").filter(F.col("cell").isin(used)), k, centres, probes)


def words(text: Column | str) -> Column:
    """Lower-case words of letters and digits of ASCII, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def bm25(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """queries (qid, text), docs (id, text): (qid, id, score, matched, terms) of documents with a word of the query: of each task the k best of a query by score and the k best by the share of words found.

    matched and terms: distinct query words found and in all. Ids are of any type that has an order; rows with a null qid or id have no part. For a corpus that is searched more than once, write an index with
    lexical.write_index and ask it with lexical.search. The texts are read once for each block of at most about BROADCAST queries: what they hold of the
    block's words is written, as numbers; from that come the numbers of documents, and then each task's scores. No pair of query and document is shuffled but the best."""
    asked = queries.filter("qid IS NOT NULL").select("qid", F.array_distinct(words("text")).alias("w")).filter(F.size("w") > 0)
    n = asked.count()
    blocks = 1 if n <= BROADCAST else -(-2 * n // max(1, BROADCAST))
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    rows = docs.filter("id IS NOT NULL").select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    if blocks == 1:
        return _bm25_block(asked, rows, k)
    return reduce(DataFrame.unionByName, [stored(_bm25_block(asked.filter(block == i), rows, k)) for i in range(blocks)])


def _counts(vocabulary: dict[str, int]):
    """Of each text its number of words and, of the words in the vocabulary, the numbers and how often they occur."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile("[a-z0-9]+").findall
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            lengths, terms, counts = [], [], []
            for text in batch["text"]:
                own = find(text.as_py())
                held = Counter(filter(vocabulary.__contains__, own))
                lengths.append(len(own))
                terms.append([vocabulary[w] for w in held])
                counts.append(list(held.values()))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(lengths, pa.int32()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["id", "length", "terms", "counts"])

    return each


def _portions(batch: pa.RecordBatch, ends: np.ndarray, queries: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch at a time that make about CELLS scores, and have about as many queries under all their terms."""
    terms = pc.list_flatten(batch["terms"]).to_numpy()
    till = np.r_[0, np.cumsum(ends[terms + 1] - ends[terms])][np.r_[0, np.cumsum(pc.list_value_length(batch["terms"]).to_numpy())]]
    i, step = 0, max(1, CELLS // max(1, queries))
    while i < batch.num_rows:
        j = max(i + 1, min(i + step, int(np.searchsorted(till, till[i] + CELLS, "right")) - 1))
        yield batch.slice(i, j - i)
        i = j


def _bm25_block(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    table = asked.toArrow().combine_chunks()
    qids, lists = table["qid"].combine_chunks(), table["w"].to_pylist()
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((asked, "qid"), (rows, "id"))]
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws in lists for w in ws}))}
    own = np.array([len(ws) for ws in lists])
    pairs = np.array([(vocabulary[w], q) for q, ws in enumerate(lists) for w in ws], np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    ends = np.searchsorted(pairs[:, 0], np.arange(len(vocabulary) + 1))  # the queries of each word lie together
    held = stored(rows.mapInArrow(_counts(vocabulary), f"id {kinds[1]}, length int, terms array<int>, counts array<int>"))
    size = held.agg(F.count("*"), F.avg("length")).first()
    df = np.zeros(len(vocabulary))
    for r in held.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[r["t"]] = r["count"]
    idf, mean = np.log(1 + ((size[0] or 0) - df + 0.5) / (df + 0.5)), size[1] or 1.0
    every = np.arange(len(qids))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_score, by_share, seen = _Running(k), _Running(k), 0
        for batch in batches:
            for part in _portions(batch.sort_by("id"), ends, len(qids)):
                ids, length = part["id"], part["length"].to_numpy()
                term, tf = (pc.list_flatten(part[c]).to_numpy() for c in ("terms", "counts"))
                doc = np.repeat(np.arange(len(ids)), pc.list_value_length(part["terms"]).to_numpy())
                weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
                n = ends[term + 1] - ends[term]
                at = np.repeat(ends[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
                cell = np.repeat(doc, n) * len(qids) + pairs[at, 1]
                matched = np.bincount(cell, minlength=len(ids) * len(qids)).reshape(len(ids), len(qids))
                score = np.bincount(cell, np.repeat(weight, n), len(ids) * len(qids)).reshape(len(ids), len(qids))
                row = np.broadcast_to(np.arange(seen, seen + len(ids))[:, None], score.shape)
                seen += len(ids)
                for kept, x in ((by_score, score), (by_share, matched / own)):
                    kept.add(every, np.where(matched > 0, np.round(x, 6), -np.inf), ids, (row, score, matched))
        known: set[tuple[int, int]] = set()  # of each task as many as there are queries, times k
        for kept in (by_score, by_share):
            for c, _, ids, (row, score, matched) in kept.parts():
                new = np.array([p not in known for p in zip(c.tolist(), row.tolist(), strict=True)])
                if kept is by_score:
                    known.update(zip(c.tolist(), row.tolist(), strict=True))
                c, ids, score, matched = c[new], ids.filter(pa.array(new)), score[new], matched[new]
                yield pa.RecordBatch.from_pydict({"qid": qids.take(pa.array(c)), "id": ids, "score": pa.array(score), "matched": pa.array(matched, pa.int64()), "terms": pa.array(own[c], pa.int64())})

    return held.mapInArrow(each, f"qid {kinds[0]}, id {kinds[1]}, score double, matched bigint, terms bigint")


def fuse(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: (qid, id, score, rank, lists); ties by the first list and the rank there."""
    rows = reduce(DataFrame.unionByName, [x.select("qid", "id", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)])
    fused = rows.groupBy("qid", "id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 6).alias("score"), F.min(F.struct("list", "rank")).alias("first"), F.count("*").alias("lists"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "first", "id")
    return fused.select("qid", "id", "score", F.row_number().over(w).alias("rank"), "lists")


def augment(main: DataFrame, other: DataFrame, group: str, extras: int = 3, least: float = 0.05) -> DataFrame:
    """main as it is, with at most so many rows of other after it: those not in main, of a group that main has, and of a score that is high enough.

    Both are rankings with the column group. hybrid marks rows of main that other has too.
    """
    both = main.join(other.select("qid", "id", F.lit(True).alias("hybrid")), ["qid", "id"], "left").withColumn("hybrid", F.coalesce("hybrid", F.lit(False)))
    new = other.filter(F.col("score") >= least).join(main.select("qid", "id"), ["qid", "id"], "left_anti").join(main.select("qid", group).distinct(), ["qid", group], "left_semi")
    n = main.groupBy("qid").agg(F.max("rank").alias("n"))
    w = Window.partitionBy("qid").orderBy("rank", "id")
    added = new.withColumn("e", F.row_number().over(w)).filter(F.col("e") <= extras).join(n, "qid").withColumn("rank", (F.col("n") + F.col("e")).cast("int")).withColumn("hybrid", F.lit(False))
    return both.unionByName(added.select(*both.columns))


def cap_and_backfill(ranked: DataFrame, group: str, k: int) -> DataFrame:
    """The k best rows of each query with at most max(3, k // 3) of one group; rows beyond that fill up what is left."""
    capped = F.row_number().over(Window.partitionBy("qid", group).orderBy("rank", "id")) > max(3, k // 3)
    w = Window.partitionBy("qid").orderBy("over", "rank", "id")
    return ranked.withColumn("over", capped).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def interleave(ranked: DataFrame) -> DataFrame:
    """place: best rows first and last (1, 3, 5, ... then the even ranks backwards), where a query has more than three rows."""
    n = F.count("*").over(Window.partitionBy("qid"))
    key = F.when((n <= 3) | (F.col("rank") % 2 == 1), F.col("rank")).otherwise(2 * n - F.col("rank"))
    return ranked.withColumn("key", key).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("key"))).drop("key")


def slice_name(slices: list[str]) -> Column:
    """Which of the slices a row of GROUPING SETS is of; '' over all. So a null label is told from a total."""
    return reduce(lambda c, s: c.when(F.grouping(s) == 0, F.lit(s)), slices, F.when(F.lit(False), F.lit(""))).otherwise(F.lit(""))


def ranking_metrics(results: DataFrame, slices: list[str]) -> DataFrame:
    """results: one row a query with first_hit (rank of the first relevant row, null: none), found, relevant (numbers) and the columns of slices.

    Hit rate, mean reciprocal rank and recall over all queries and by each of the slices, in one aggregation (GROUPING SETS); slice names which. results may have errored (true: the query failed; it counts in n and
    n_errored, and as a miss) and pub_hit (whether the first result is of the expected publication; null counts as not): then n_errored and pub_accuracy come too.
    """
    sets = results.groupingSets([[], *([F.col(s)] for s in slices)], *(F.col(s) for s in slices))
    recall = F.coalesce(F.col("found") / F.nullif(F.col("relevant"), F.lit(0)), F.lit(0.0))
    more = [F.count_if(F.coalesce("errored", F.lit(False))).alias("n_errored")] if "errored" in results.columns else []
    more += [F.round(F.avg(F.coalesce("pub_hit", F.lit(False)).cast("int")), 6).alias("pub_accuracy")] if "pub_hit" in results.columns else []
    return sets.agg(
        slice_name(slices).alias("slice"), *more,
        F.count("*").alias("n"), F.round(F.avg(F.col("first_hit").isNotNull().cast("int")), 6).alias("hit_rate"),
        F.round(F.avg(F.coalesce(1 / F.col("first_hit"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(recall), 6).alias("recall"),
    )
