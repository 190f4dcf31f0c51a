"""Toxicity by multiple-instance learning: only whole documents are labelled, the sentences that make them toxic are found.

A sentence's features are its words and their first four to six letters, lower-cased. Its score is sigmoid(bias + sum of the weights of its
features); a document's is the noisy-or of its sentences, 1 - prod(1 - p). Weights are trained on document labels through the noisy-or, on a bounded
sample of labelled documents whose features were selected by a likelihood-ratio test; classes count by their share of all labels. Scoring reads
each whole text once and also returns the sentences whose own score is at least SENTENCE.

Nulls: a null text is the empty text. A text without a sentence has score 0. Repeated rows are scored each. Without labels of both classes no
feature is selected and each score is that of the bias alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, drop_written, labelled_sample, map_batches, written

#: Bounds of the sample and of the model: labelled documents of either class (by hash of the id), and features.
PER_CLASS, FEATURES = 3000, 4096
LEAST_DOCS, SENTENCE, STEPS, RATE, RIDGE, BIAS = 3, 0.5, 1000, 0.1, 2e-6, -8.0
_SENTENCE, _WORD = re.compile(r"[^.!?\n]+[.!?]*"), re.compile(r"\w+")


def sentence_features(sentence: str) -> set[str]:
    """Words, and their first 4, 5 and 6 letters marked with a star."""
    words = set(_WORD.findall(sentence.lower()))
    return words | {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) > n}


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    @cached_property
    def opening(self) -> set[str]:
        """The first four letters of all words that can have a feature with a weight."""
        return {f.rstrip("*")[:4] for f in self.weights}

    def sentences(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and (start, length, score) of its offending sentences."""
        weights, opening, find = self.weights, self.opening, _WORD.findall
        plain, total, found = _softplus(self.bias), 0.0, []
        for m in _SENTENCE.finditer(text):
            words = [w for w in find(m[0].lower()) if w[:4] in opening]
            if not words:
                total += plain
                continue
            features = {f for w in words for f in (w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) > n))}
            z = self.bias + math.fsum(weights.get(f, 0.0) for f in features)
            total += _softplus(z)
            p = 1 / (1 + math.exp(-max(z, -500.0)))
            if p >= SENTENCE:
                found.append((m.start(), len(m[0]), p))
        return -math.expm1(-total), found


def _softplus(z: float) -> float:
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


def _feature_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class by feature, summed over each batch."""
    for batch in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist(), strict=True):
            seen[label].update(sentence_features(text or ""))
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "clean": pa.array([seen[0][n] for n in names], pa.int64()), "toxic": pa.array([seen[1][n] for n in names], pa.int64())})


def select(sample: DataFrame, features: int = FEATURES) -> list[str]:
    """The features whose share of documents differs most between the classes."""
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(n) < 2:
        return []
    counts = map_batches(sample, _feature_counts, "feature string, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = (F.col("clean") + F.col("toxic")) / (n[0] + n[1])
    gain = lambda k, m: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / m / share)).otherwise(0.0) + F.when(F.col(k) < m, (m - F.col(k)) * F.log((1 - F.col(k) / m) / (1 - share))).otherwise(0.0)
    ranked = counts.filter(F.col("clean") + F.col("toxic") >= LEAST_DOCS).withColumn("gain", gain("clean", n[0]) + gain("toxic", n[1]))
    return [r["feature"] for r in ranked.orderBy(F.desc("gain"), "feature").limit(features).collect()]


def _bags(chosen: list[str]):
    """For each document its label, its number of sentences, and the selected features of those that have any."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {f: i for i, f in enumerate(chosen)}
        for batch in batches:
            rows = []
            for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist(), strict=True):
                sentences = _SENTENCE.findall(text or "")
                found = [sorted({number[f] for f in sentence_features(s) if f in number}) for s in sentences]
                rows.append((label, len(sentences), [x for x in found if x]))
            columns = zip(*rows, strict=True) if rows else [()] * 3
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["label", "n", "bags"])

    return each


def train(labels: np.ndarray, n: np.ndarray, bags: list[list[list[int]]], features: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent (Adam) on the log loss of the noisy-or. prior: the share of label 1 that the sample stands for."""
    doc = np.array([d for d, b in enumerate(bags) for _ in b], np.int64)
    at = count()
    where = np.array([(i, f) for b in bags for s in b for i in [next(at)] for f in s], np.int64).reshape(-1, 2)
    rest = n - np.bincount(doc, minlength=len(bags))
    y = labels.astype(float)
    part = np.where(y == 1, prior / max(y.sum(), 1), (1 - prior) / max((1 - y).sum(), 1))
    x = np.zeros(features + 1)
    x[-1] = BIAS
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        z = x[-1] + np.bincount(where[:, 0], x[where[:, 1]], len(doc))
        total = np.maximum(np.bincount(doc, np.logaddexp(0, z), len(bags)) + rest * np.logaddexp(0, x[-1]), 1e-9)
        slope = part * ((1 - y) - y * np.exp(-total) / -np.expm1(-total))
        dz = slope[doc] / (1 + np.exp(-z))
        g = np.append(np.bincount(where[:, 1], dz[where[:, 0]], features), dz.sum() + (slope * rest).sum() / (1 + np.exp(-x[-1])))
        g[:-1] += RIDGE * x[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:-1], float(x[-1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, features: int = FEATURES) -> Model:
    """labels (doc_id, toxic): only rows that may be learned from."""
    ids = labelled_sample(labels, "toxic", per_class)
    sample = written(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("label", "text"), "toxic-sample")
    chosen = select(sample, features)
    share = labels.agg(F.avg((F.col("toxic") == 1).cast("int"))).first()[0]
    rows = map_batches(sample, _bags(chosen), "label int, n int, bags array<array<int>>").toPandas() if chosen else None
    drop_written(sample)
    if rows is None or not len(rows):
        return Model({}, BIAS)
    rows = rows.iloc[np.lexsort((rows["bags"].map(lambda b: str([list(s) for s in b])), rows["n"], rows["label"]))]
    weights, bias = train(rows["label"].to_numpy(), rows["n"].to_numpy(), rows["bags"].tolist(), len(chosen), min(max(share, 0.01), 0.99))
    return Model({f: float(w) for f, w in zip(chosen, weights, strict=True) if abs(w) > 0.05}, bias)


def toxicity(text: Column | str, model: Model) -> Column:
    """A struct: the score of the whole text, and its offending sentences by start and length in code points, with their scores."""

    def each(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))
        for array in texts:
            found = [model.sentences(t.as_py() or "") for t in array]
            spans = [[dict(zip(("start", "length", "score"), s, strict=True)) for s in f[1]] for f in found]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array(spans, kind)], ["score", "sentences"])

    return arrow_column(each, "struct<score:double,sentences:array<struct<start:int,length:int,score:double>>>", text)
