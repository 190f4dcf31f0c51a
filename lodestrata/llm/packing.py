"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents longer than a sequence are cut into whole sequences, the first piece being what is left over. What is shorter than a sequence is packed.
The pieces are dealt at random into blocks of about SEQUENCES full sequences, or BLOCK pieces where those are short; each block is packed by ISLANDS
islands. On an island a chromosome is a set of bins; crossover injects whole well-filled bins of one parent into the other, takes out the bins that
hold an injected piece and best-fits the pieces they leave; mutation empties bins, most of those with room and some of the full ones, and best-fits what was in them. The first chromosomes are
best fits of the pieces in random orders, which leave bins half empty; all that is gained on them comes of the generations. Of equally many bins those filled more unequally are better. Islands evolve as rows of a table;
between epochs each sends its best chromosome to the next island of its block by a join. The best of a block's islands is its packing. An island stops as
soon as it has as few bins as its tokens need. What the blocks leave in bins that
aren't well filled is packed once more, many blocks' together and with the bins as they are among the parents, so that half-empty bins meet and no sequence is lost by it.

Nulls: a null text is the empty text, its end id alone; null and repeated ids are kept and packed as rows of their own. Ids are whole numbers; an id that isn't one is an error. An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, fresh, map_batches, written
from .token_files import with_end
from .tokenizing import default_tokenizer, encoder, portions

CAPACITY, SEQUENCES, BLOCK, ISLANDS, EPOCHS, POPULATION, GENERATIONS, EFFORT, WELL, OPEN, SEED = 2048, 4096, 65_536, 3, 3, 6, 10, 120_000, 0.995, 0.98, 42
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _pieces(tokenizer: str, end_id: int, capacity: int):
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                tokens, at = with_end(*encoder(tokenizer).encode(part["text"]), end_id)
                size = np.diff(at)
                short = np.where(size % capacity, size % capacity, capacity)
                n = (size - short) // capacity + 1
                doc = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                begin = np.where(piece == 0, 0, short[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, short[doc], capacity)
                raw, place = memoryview(tokens.tobytes()), (at[:-1][doc] + begin) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(place.tolist(), (place + 4 * length).tolist(), strict=True)]
                columns = [part["doc_id"].take(pa.array(doc)), *(pa.array(c, k) for c, k in ((piece, pa.int32()), (begin, pa.int64()), (length, pa.int64()), (crc, pa.int64())))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return each


def cut(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document of at most capacity tokens: id, piece, start, length and crc32 of the ids."""
    return map_batches(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), _pieces(tokenizer or default_tokenizer(), end_id, capacity), PIECES)


def best_fit(sizes: list[int], items: Iterable[int], bins: np.ndarray, loads: list[int], capacity: int) -> None:
    """Puts each item into the fullest bin that has room, or into a new one."""
    free = sorted((capacity - load, b) for b, load in enumerate(loads) if load < capacity)
    for i in items:
        k = bisect_left(free, (sizes[i], -1))
        if k < len(free):
            room, b = free.pop(k)
        else:
            room, b = capacity, len(loads)
            loads.append(0)
        bins[i] = b
        loads[b] += sizes[i]
        if room > sizes[i]:
            insort(free, (room - sizes[i], b))


def pack(sizes: np.ndarray, order: Iterable[int], capacity: int) -> np.ndarray:
    bins, loads = np.empty(len(sizes), np.int32), []
    best_fit(sizes.tolist(), order, bins, loads, capacity)
    return bins


def _refit(sizes: np.ndarray, bins: np.ndarray, out: np.ndarray, capacity: int, rng: np.random.Generator | None = None) -> np.ndarray:
    """bins without the items marked out, which are then best-fitted: largest first or, with rng, nearly so."""
    _, kept = np.unique(bins[~out], return_inverse=True)
    new = np.empty(len(bins), np.int32)
    new[~out] = kept
    loads = np.bincount(kept, sizes[~out]).astype(int).tolist() if len(kept) else []
    loose = np.flatnonzero(out)
    weight = sizes[loose] * (1 if rng is None else rng.uniform(0.8, 1.2, len(loose)))
    best_fit(sizes.tolist(), loose[np.argsort(-weight, kind="stable")].tolist(), new, loads, capacity)
    return new


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then those of unequal fill. Lower is better."""
    loads = np.bincount(bins, sizes)
    return len(loads), -float(np.mean((loads / capacity) ** 2))


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Some of b's well-filled bins, whole, in a."""
    loads = np.bincount(b, sizes)
    good = np.flatnonzero(loads >= WELL * capacity)
    if not len(good):
        return a
    taken = rng.choice(good, max(1, len(good) // 8), replace=False)
    injected = np.isin(b, taken)
    touched = np.isin(a, np.unique(a[injected]))
    child = a.copy()
    child[injected] = b[injected] + a.max() + 1
    return _refit(sizes, child, touched & ~injected, capacity)


def mutate(sizes: np.ndarray, bins: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A share of the bins with room, and a smaller one of the full bins, are emptied; both shares are drawn anew each time."""
    loads = np.bincount(bins, sizes)
    open_, full = rng.uniform(0.3, 1), rng.uniform(0, 0.6)
    chosen = np.flatnonzero(rng.random(len(loads)) < np.where(loads < capacity, open_, full))
    return _refit(sizes, bins, np.isin(bins, chosen), capacity, rng if rng.random() < 0.5 else None)


def evolve(sizes: np.ndarray, elites: list[np.ndarray], capacity: int, seed: list[int], generations: int | None = None) -> tuple[np.ndarray, int]:
    """The best chromosome of an island, and after how many generations, at most more in small blocks. elites: those it has or was sent; none at the start."""
    rng, least = np.random.default_rng(seed), -(-int(sizes.sum()) // capacity)
    rated = lambda c: (fitness(sizes, c, capacity), c)
    population = [rated(c) for c in elites]
    best = lambda: min(population, key=lambda p: p[0])
    if population and best()[0][0] <= least:
        return best()[1], 0
    while len(population) < POPULATION:
        population.append(rated(pack(sizes, rng.permutation(len(sizes)).tolist(), capacity)))
    done, most = 0, max(GENERATIONS, min(200, EFFORT // max(1, len(sizes)))) if generations is None else generations
    while best()[0][0] > least and done < most:
        population.sort(key=lambda p: p[0])
        i, j = rng.choice(len(population), 2, replace=False)
        population[-1] = rated(mutate(sizes, crossover(sizes, population[min(i, j)][1], population[max(i, j)][1], capacity, rng), capacity, rng))
        done += 1
    return best()[1], done


STATE = "block bigint, island int, uids array<bigint>, sizes array<int>, bins array<int>, n_bins int, generations int"


def _epoch(epoch: int, capacity: int, seed: int):
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, n, generations = [], [], []
            for block, island, sizes, own, sent, before in zip(*(batch[c].to_pylist() for c in ("block", "island", "sizes", "bins", "sent", "generations")), strict=True):
                found, more = evolve(np.array(sizes, np.int64), [np.array(c, np.int32) for c in (own, sent) if c is not None], capacity, [seed, epoch, block, island])
                bins.append(found)
                n.append(int(found.max()) + 1 if len(found) else 0)
                generations.append(before + more)
            columns = [*(batch[c] for c in ("block", "island", "uids", "sizes")), pa.array(bins, pa.list_(pa.int32())), pa.array(n, pa.int32()), pa.array(generations, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "island", "uids", "sizes", "bins", "n_bins", "generations"])

    return each


def _blocks(loose: DataFrame, capacity: int, sequences: int, block: int) -> int:
    """So many blocks that none has more than about so many full sequences or pieces."""
    n, tokens = loose.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return max(1, -(-n // block), -(-tokens // (capacity * sequences)))


def _evolved(items: DataFrame, n: int, capacity: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """items (block, uid, size and, where they are in bins already, bin) of n blocks to (block, uids, sizes, bins, generations): the best of the islands of each block, and the generations of all of them."""
    binned = "bin" in items.columns
    item = F.struct("size", "uid", *(["bin"] if binned else []))
    blocks = items.groupBy("block").agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
    own = F.col("items.bin") if binned else F.lit(None).cast("array<int>")
    state = blocks.select("block", F.explode(F.array(*(F.lit(i) for i in range(islands)))).alias("island"), F.col("items.uid").alias("uids"), F.col("items.size").alias("sizes"), own.alias("bins"), F.lit(None).cast("array<int>").alias("sent"), F.lit(0).alias("generations"))
    state = written(map_batches(state.repartition(n * islands, "block", "island"), _epoch(0, capacity, seed), STATE), "islands")
    for epoch in range(1, epochs):
        sent = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("bins").alias("sent"))
        after = written(map_batches(state.join(sent, ["block", "island"]), _epoch(epoch, capacity, seed), STATE), "islands")
        drop_written(state)
        state = after
    return state.groupBy("block").agg(F.min_by(F.struct("uids", "sizes", "bins"), F.struct("n_bins", "island")).alias("best"), F.sum("generations").alias("generations")).select("block", "best.*", "generations")


def _placed(best: DataFrame) -> DataFrame:
    """(block, uid, size, bin, generations) of each piece."""
    at = F.explode(F.arrays_zip("uids", "sizes", "bins")).alias("at")
    return best.select("block", "generations", at).select("block", "generations", F.col("at.uids").alias("uid"), F.col("at.sizes").alias("size"), F.col("at.bins").alias("bin"))


def packed(pieces: DataFrame, capacity: int = CAPACITY, sequences: int = SEQUENCES, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """pieces (with a length, at most capacity) and for each its sequence_id, its offset there, gapless from 0, and generations, which the islands of its block took in the round that placed it (0 for pieces that fill a sequence). Columns of pieces that are called so give way."""
    (uid,) = fresh(pieces, "uid")
    rows = written(pieces.drop("sequence_id", "offset", "generations").withColumn(uid, F.monotonically_increasing_id()), "pieces")
    loose = rows.filter(F.col("length") < capacity).select(F.col(uid).alias("uid"), "length")
    n = _blocks(loose, capacity, sequences, block)
    dealt = loose.select(F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(n)).alias("block"), "uid", F.col("length").cast("int").alias("size"))
    first = written(_placed(_evolved(dealt, n, capacity, islands, epochs, seed)), "packed")
    loads = first.groupBy("block", "bin").agg(F.sum("size").alias("load")).filter(F.col("load") <= OPEN * capacity)
    left = written(first.drop("generations").join(loads.select("block", "bin"), ["block", "bin"]), "open-bins")
    m = _blocks(left.withColumnRenamed("size", "length"), capacity, sequences, block)
    again = left.withColumnRenamed("block", "from").withColumn("block", F.pmod(F.xxhash64("from", F.lit(seed)), F.lit(m)))
    number = F.dense_rank().over(Window.partitionBy("block").orderBy("from", "bin")) - 1
    second = _placed(_evolved(again.select("block", "uid", "size", number.alias("bin")), m, capacity, islands, epochs, seed + 1))
    name = lambda d, side: d.select("uid", ((F.col("block") * 2 + side) * (1 << 24) + F.col("bin")).alias("sequence_id"), "generations")
    places = name(first.join(left.select("uid"), "uid", "left_anti"), 0).unionByName(name(second, 1)).withColumnRenamed("uid", uid)
    done = rows.join(places, uid, "left").withColumn("sequence_id", F.coalesce("sequence_id", -1 - F.col(uid))).withColumn("generations", F.coalesce("generations", F.lit(0)))
    before = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), uid).rowsBetween(Window.unboundedPreceding, -1)
    return done.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop(uid)
