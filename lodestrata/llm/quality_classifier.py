"""Quality classifier: a sparse rule ensemble.

Shallow trees over text statistics give conjunctive rules (one for each path from a root); lasso logistic regression weighs the rules, most to
zero; what is left is one Spark column expression, so scoring is one pass over the texts. Only the statistics of a bounded sample of labelled
rows reach the driver; the trees, each grown on half of the sample and a third of the features at each split, and the lasso are fitted there. Where the
bound cuts a class short its rows count for as many as they stand for, so scores keep to the share that the labels have.

Nulls: a null text is scored as the empty text; a null id is in no fold and is not learned from. Repeated rows are scored each. Without labels of
both classes every score is the share of label 1 (0.5 if there are no labels). Other columns never reach the score.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import class_weights, labelled_sample
from .text_stats import features, text_counts

#: Bounds of the labelled sample: so many rows of either class, chosen by hash of the id.
PER_CLASS = 10_000
TREES, DEPTH, CUTS, LEAF, LASSO, STEPS, SEED = 24, 3, 64, 5, 0.002, 2000, 42
Term = tuple[str, str, float]


@dataclass
class RuleEnsemble:
    """score = sigmoid(intercept + sum of the weights of the rules that hold)."""

    rules: list[tuple[tuple[Term, ...], float]]
    intercept: float

    def score(self, stats: dict[str, Column]) -> Column:
        total = reduce(lambda a, r: a + F.when(conjunction(r[0], stats), F.lit(r[1])).otherwise(F.lit(0.0)), self.rules, F.lit(self.intercept))
        return 1.0 / (1.0 + F.exp(-total))


def conjunction(terms: tuple[Term, ...], stats: dict[str, Column]) -> Column:
    return reduce(and_, (stats[f] > F.lit(t) if op == ">" else stats[f] <= F.lit(t) for f, op, t in terms))


def tree_paths(x: np.ndarray, y: np.ndarray, names: list[str], rng: np.random.Generator, path: tuple[Term, ...] = (), w: np.ndarray | None = None) -> list[tuple[Term, ...]]:
    """Every path from the root of a tree grown on x, y by Gini impurity: one bound for each feature and side."""
    if len(path) == DEPTH or len(y) < 2 * LEAF or y.min() == y.max():
        return []
    w = np.ones(len(y)) if w is None else w
    best: tuple[float, int, float] | None = None
    for j in sorted(rng.choice(len(names), max(1, len(names) // 3), replace=False)):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS), method="lower"))[:-1]
        if not len(cuts):
            continue
        side = np.searchsorted(cuts, x[:, j], side="left")
        rows = np.cumsum(np.bincount(side, minlength=len(cuts) + 1))[:-1]
        n, p = (np.cumsum(np.bincount(side, v, len(cuts) + 1))[:-1] for v in (w, w * y))
        m, q = w.sum() - n, (w * y).sum() - p
        mixed = np.where((rows >= LEAF) & (len(y) - rows >= LEAF), p * (n - p) / np.maximum(n, 1e-9) + q * (m - q) / np.maximum(m, 1e-9), np.inf)
        k = int(np.argmin(mixed))
        if np.isfinite(mixed[k]) and (best is None or mixed[k] < best[0]):
            best = (float(mixed[k]), int(j), float(cuts[k]))
    if best is None:
        return []
    _, j, cut = best
    out: list[tuple[Term, ...]] = []
    for op, rows in (("<=", x[:, j] <= cut), (">", x[:, j] > cut)):
        tight = {(f, o): t for f, o, t in path} | {(names[j], op): cut}
        deeper = tuple(sorted((f, o, t) for (f, o), t in tight.items()))
        out += [deeper, *tree_paths(x[rows], y[rows], names, rng, (*path, (names[j], op, cut)), w[rows])]
    return out


def lasso_logistic(held: np.ndarray, y: np.ndarray, penalty: float = LASSO, w: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient steps; equal rows are fitted once, by their counts."""
    rows, at = np.unique(held, axis=0, return_inverse=True)
    own = np.ones(len(y)) if w is None else w
    n, p = (np.bincount(at.ravel(), v, len(rows)) / own.sum() for v in (own, own * y))
    x = np.hstack([rows.astype(float), np.ones((len(rows), 1))])
    step = 4 / np.linalg.eigvalsh((x * n[:, None]).T @ x)[-1]
    w = v = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(STEPS):
        gradient = x.T @ (n / (1 + np.exp(-np.clip(x @ v, -500, 500))) - p)
        u = v - step * gradient
        u[:-1] = np.sign(u[:-1]) * np.maximum(np.abs(u[:-1]) - step * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, v = u, u + (before - 1) / t * (u - w)
    return w[:-1], float(w[-1])


def fit_ensemble(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = SEED, w: np.ndarray | None = None) -> RuleEnsemble:
    """y: 0.0 or 1.0; w: how many rows each stands for. Without both classes there are no rules and the score is the share of 1."""
    if not len(y) or y.min() == y.max():
        share = np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3) if len(y) else 0.5
        return RuleEnsemble([], float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    rules: set[tuple[Term, ...]] = set()
    for _ in range(TREES):
        half = rng.permutation(len(x))[: max(len(x) // 2, min(len(x), 2 * LEAF))]
        rules.update(tree_paths(x[half], y[half], names, rng, (), None if w is None else w[half]))
    ordered = sorted(rules)
    columns = [np.logical_and.reduce([x[:, names.index(f)] > t if op == ">" else x[:, names.index(f)] <= t for f, op, t in r]) for r in ordered]
    if not columns:
        return fit_ensemble(x, np.full(len(y), np.average(y, weights=w)), names, seed)
    weights, intercept = lasso_logistic(np.column_stack(columns), y, LASSO, w)
    return RuleEnsemble([(r, float(w)) for r, w in zip(ordered, weights, strict=True) if abs(w) > 1e-6], intercept)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> RuleEnsemble:
    """labels (doc_id, quality): only rows that may be learned from."""
    ids = labelled_sample(labels, "quality", per_class)
    stats = features("s")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("label", text_counts("text").alias("s"))
    table = rows.select("label", *(c.alias(n) for n, c in stats.items())).toPandas()
    table = table.sort_values(list(table.columns), ignore_index=True)
    weights = class_weights(labels, "quality", table["label"].value_counts().to_dict())
    return fit_ensemble(table[list(stats)].to_numpy(float), table["label"].to_numpy(float), list(stats), SEED, table["label"].map(weights).to_numpy(float))


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """doc_id and score for each row of docs, from its whole text alone."""
    return docs.select("doc_id", text_counts("text").alias("s")).select("doc_id", model.score(features("s")).alias("score"))
