import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import quality_classifier, quality_rules, text_stats
from lodestrata.llm.common import fold, learnable

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """The base counts, straight from their definition."""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", " ", "\n", "\t", "\x0b", "\xa0", "日|", "  ", "\x1c"]), max_size=60).map("".join))
def test_counts_equal_their_definition(text):
    assert text_stats.counts(text.encode(), len(text))[:5] == brute(text)


ROWS = [(1, "clean words in a row " * 1 + "that say one thing after another quite plainly", "x"), (2, None, "x"), (3, "", None), (None, "### $$$ " * 40, "y"), (4, "same same " * 60, "y"), (4, "same same " * 60, "y")]


def test_judge_of_nulls_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, counts string")
    rule = quality_rules.Rule((("symbols", ">", 0.1),))
    got = quality_rules.judge(docs, [rule]).select("doc_id", "text", "counts", "quality.*").collect()
    assert len(got) == len(ROWS)
    for row in got:
        words, chars, symbols, dups, repeats = brute(row["text"] or "")
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == (words, chars, symbols, dups, repeats)
        assert row["base_failed"] == (words < 10 or 100 * repeats > 20 * words)
        assert row["kept"] == (not row["base_failed"] and symbols <= 0.1 * max(chars, 1))
    assert [r["doc_id"] for r in quality_rules.keep_good(docs, [rule]).collect()] == [1]
    assert quality_rules.keep_good(docs, [rule]).columns == docs.columns
    assert quality_rules.keep_good(docs.limit(0), []).count() == 0


def test_covering_finds_the_planted_rules():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(3000, 4))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] > 0.7) & (x[:, 2] <= 0.2))
    rules = quality_rules.learn_rules(x, bad, list("abcd"))
    hit = quality_rules.rejects(rules, x, list("abcd"))
    assert (hit == bad).mean() > 0.98 and not any(f == "d" for r in rules for f, _, _ in r.terms[:1])
    assert (~bad | hit).mean() > 0.99 and any(not r.keep for r in rules) and not rules[-1].keep
    assert quality_rules.learn_rules(x, np.zeros(3000, bool), list("abcd")) == [] == quality_rules.learn_rules(x, np.ones(3000, bool), list("abcd"))


def test_rules_as_columns_agree_with_masks(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(300, 2))
    rule = quality_rules.Rule((("a", ">", 0.3), ("b", "<=", 0.6)))
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    got = [r[0] for r in rows.select(rule.column({"a": F.col("a"), "b": F.col("b")})).collect()]
    assert got == rule.mask(x, ["a", "b"]).tolist()


def test_ensemble_on_rows_it_has_not_seen():
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(4000, 5))
    y = ((x[:, 0] > 0.4) & (x[:, 1] <= 0.7)).astype(float)
    model = quality_classifier.fit_ensemble(x[:3000], y[:3000], list("abcde"))
    total = np.full(1000, model.intercept)
    for terms, weight in model.rules:
        total += weight * np.logical_and.reduce([x[3000:, "abcde".index(f)] > t if op == ">" else x[3000:, "abcde".index(f)] <= t for f, op, t in terms])
    assert ((total > 0) == (y[3000:] == 1)).mean() > 0.97
    weighed = len({r for r, _ in model.rules})
    assert 0 < weighed < 24 * 14 / 2  # sparse


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (None, 0)]])
def test_fit_without_both_classes(spark, labels):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    assert quality_rules.learn(docs, frame) == []
    model = quality_classifier.fit(docs, frame)
    scores = [r["score"] for r in quality_classifier.score(docs, model).collect()]
    assert model.rules == [] and len(scores) == len(ROWS) and all(0 < s < 1 for s in scores)


def test_held_out_rows_are_not_learned_from(spark):
    import zlib

    labels = spark.createDataFrame([(i, 1) for i in range(200)] + [(None, 1)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in learnable(labels, 5, 0).collect()}
    assert kept == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 0}
    assert labels.filter(fold("doc_id", 5).isNull()).count() == 1
