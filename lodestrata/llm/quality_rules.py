"""Quality rules: a learned decision list over text statistics (sequential covering with grow and prune sets).

Each rule is a conjunction of at most MAX_TERMS thresholds with a verdict, keep or reject. In each turn a rule for either verdict is grown on two thirds of the labelled rows by FOIL gain and pruned on the
other third by (p - n) / (p + n); of those that are precise enough there the one that covers more comes next in the list. What it covers is removed and the next turn begins, so later rules are sought among what is left and hold only there. The list is emitted as
ordered ``when(...).when(...).otherwise(...)``, so a rule decides only what no rule before it does, and runs inside Spark's generated code. What no rule decides is kept.

Nulls: a null text is the empty text. Empty texts have no words and fail the base rule. Repeated rows are each judged alone. Without labels of
both classes the list is empty and only the base rule rejects. An empty table gives an empty table; other columns are passed through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import class_weights, fresh, labelled_sample
from .text_stats import features, text_counts

#: Bounds of the labelled sample that rules are learned from: so many rows of either class, chosen by hash of the id.
PER_CLASS = 10_000
MAX_RULES, MAX_TERMS, CUTS, MIN_PRECISION, KEEP_PRECISION, SEED = 24, 4, 64, 0.9, 0.995, 42


@dataclass(frozen=True)
class Rule:
    """Rejects, or keeps, what meets all terms: (feature, ">" or "<=", threshold)."""

    terms: tuple[tuple[str, str, float], ...]
    precision: float = field(compare=False, default=1.0)
    keep: bool = False
    covered: float = field(compare=False, default=0.0)

    def column(self, stats: dict[str, Column]) -> Column:
        return reduce(and_, (stats[f] > F.lit(t) if op == ">" else stats[f] <= F.lit(t) for f, op, t in self.terms))

    def mask(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        return reduce(and_, (x[:, names.index(f)] > t if op == ">" else x[:, names.index(f)] <= t for f, op, t in self.terms), np.ones(len(x), bool))


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], w: np.ndarray) -> Rule:
    terms: list[tuple[str, str, float]] = []
    held = np.ones(len(x), bool)
    for _ in range(MAX_TERMS):
        p0, n0 = w[y & held].sum(), w[~y & held].sum()
        if not p0 or not n0:
            break
        base, best, found = np.log2(p0 / (p0 + n0)), 1e-9, None
        for j, name in enumerate(names):
            value, yes, own = x[held, j], y[held], w[held]
            for cut in np.unique(np.quantile(value, np.linspace(0, 1, CUTS), method="lower")):
                above = value > cut
                for op, hit in ((">", above), ("<=", ~above)):
                    p, n = own[hit & yes].sum(), own[hit & ~yes].sum()
                    gain = p * (np.log2(p / (p + n)) - base) if p else 0.0
                    if gain > best + 1e-9:
                        best, found = gain, (name, op, float(cut))
        if found is None:
            break
        terms.append(found)
        held &= Rule((found,)).mask(x, names)
    return Rule(tuple(terms))


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray, names: list[str], w: np.ndarray) -> Rule:
    def worth(k: int) -> float:
        hit = Rule(rule.terms[:k]).mask(x, names)
        p, n = w[hit & y].sum(), w[hit & ~y].sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = max(range(1, len(rule.terms) + 1), key=lambda k: (worth(k), -k))
    hit = Rule(rule.terms[:best]).mask(x, names)
    return Rule(rule.terms[:best], float((worth(best) + 1) / 2), rule.keep, float(w[hit & y].sum() - w[hit & ~y].sum()))


def learn_rules(x: np.ndarray, rejected: np.ndarray, names: list[str], seed: int = SEED, w: np.ndarray | None = None) -> list[Rule]:
    """Ordered rules of both verdicts for the rows of x that are marked rejected or not; none where either class is missing, and none that no row put by for pruning bears out. w: how many rows each stands for.

    Keeping rules after the last rejecting one say what holds without them and are left out."""
    w = np.ones(len(x)) if w is None else w
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    while rejected.any() and not rejected.all() and len(rules) < MAX_RULES:
        part = rng.permutation(len(x)) % 3 < 2
        found = []
        for keep in (False, True):
            wanted = ~rejected if keep else rejected
            rule = _grow(x[part], wanted[part], names, w[part])
            if rule.terms:
                rule = _prune(rule, x[~part], wanted[~part], names, w[~part])
                if rule.precision >= (KEEP_PRECISION if keep else MIN_PRECISION):
                    found.append(replace(rule, keep=keep))
        if not found:
            break
        rule = max(found, key=lambda r: (r.covered, not r.keep))
        rest = ~rule.mask(x, names)
        if rest.all():
            break
        rules.append(rule)
        x, rejected, w = x[rest], rejected[rest], w[rest]
    while rules and rules[-1].keep:
        rules.pop()
    return rules


def rejects(rules: list[Rule], x: np.ndarray, names: list[str]) -> np.ndarray:
    """Where the list rejects rows of x: the first rule that holds decides."""
    out, open_ = np.zeros(len(x), bool), np.ones(len(x), bool)
    for rule in rules:
        hit = open_ & rule.mask(x, names)
        out |= hit & (not rule.keep)
        open_ &= ~hit
    return out


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[Rule]:
    """Rules from documents with a quality label. Only the statistics of at most 2 * per_class labelled rows reach the driver."""
    ids = labelled_sample(labels, "quality", per_class)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("label", text_counts("text").alias("s"))
    stats = features("s")
    table = rows.select("label", *(c.alias(n) for n, c in stats.items())).toPandas()
    table = table.sort_values(list(table.columns), ignore_index=True)
    weights = class_weights(labels, "quality", table["label"].value_counts().to_dict())
    return learn_rules(table[list(stats)].to_numpy(float), (table["label"] == 0).to_numpy(), list(stats), SEED, table["label"].map(weights).to_numpy(float))


def base_failed(c: str) -> Column:
    return (F.col(f"{c}.n_words") < 10) | (100 * F.col(f"{c}.n_repeat_words") > 20 * F.col(f"{c}.n_words"))


def verdict(c: str, rules: list[Rule]) -> Column:
    """True where the document is kept: the first rule that holds decides, none: kept."""
    stats, out = features(c), F.when(base_failed(c), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(stats), F.lit(rule.keep))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text", out: str = "quality") -> DataFrame:
    """docs with one more column, a struct: the counts of each whole text, base_failed and kept."""
    (c,) = fresh(docs, "counts")
    counted = docs.withColumn(c, text_counts(text_col))
    return counted.withColumn(out, F.struct(f"{c}.*", base_failed(c).alias("base_failed"), verdict(c, rules).alias("kept"))).drop(c)


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    (q,) = fresh(docs, "quality")
    return judge(docs, rules, text_col, q).filter(F.col(f"{q}.kept")).drop(q)
