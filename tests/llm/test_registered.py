"""Each registered query of the training-data operators on its whole tables, against a plain recomputation of its columns."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tests.llm.test_audio import brute
from tests.llm.test_quality import brute as brute_counts
from tests.llm.test_simhash import brute_components, brute_print
from tests.llm.test_tokens import check_packing, direct

from lodestrata.llm import audio, quality_classifier, quality_rules, toxicity
from lodestrata.llm.common import learnable
from lodestrata.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return {r["doc_id"]: r["text"] for r in rows}


def rows_of(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_op1(spark, docs):
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(table, learnable(labels, 4, 2))
    got = {r["doc_id"]: r for r in rows_of(spark, "op1_toxicity")}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        r, clean = got[i], 1.0
        for s in toxicity._SENTENCE.findall(text or ""):
            z = model.bias + math.fsum(model.weights.get(f, 0.0) for f in toxicity.sentence_features(s))
            clean *= 1 - 1 / (1 + math.exp(-z))
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) and r["score"] == pytest.approx(1 - clean, abs=1e-9)
        assert r["n_sentences"] == len(r["sentences"]) and all(0 <= s["start"] and s["start"] + s["length"] <= len(text or "") for s in r["sentences"])


def test_gradient_of_the_noisy_or():
    """One step of the descent moves each weight against the sign of the loss's numerical slope."""
    labels, n = np.array([1, 0, 1, 0]), np.array([2, 3, 1, 1])
    bags = [[[0], [1, 2]], [[1]], [[0, 2]], []]
    share = 0.4

    def loss(x):
        out = 0.0
        for y, m, b in zip(labels, n, bags, strict=True):
            total = sum(np.logaddexp(0, x[-1] + sum(x[f] for f in s)) for s in b) + (m - len(b)) * np.logaddexp(0, x[-1])
            weight = share / 2 if y else (1 - share) / 2
            out += weight * (-math.log(-math.expm1(-total)) if y else total)
        return out + toxicity.RIDGE / 2 * (x[:-1] ** 2).sum()

    start = np.array([0.0, 0.0, 0.0, toxicity.BIAS])
    slope = [(loss(start + 1e-6 * e) - loss(start - 1e-6 * e)) / 2e-6 for e in np.eye(4)]
    steps = toxicity.STEPS
    toxicity.STEPS = 1
    try:
        weights, bias = toxicity.train(labels, n, bags, 3, share)
    finally:
        toxicity.STEPS = steps
    assert np.array_equal(np.sign(np.append(weights, bias) - start), -np.sign(slope))
    final = np.append(*toxicity.train(labels, n, bags, 3, share))
    after = [(loss(final + 1e-6 * e) - loss(final - 1e-6 * e)) / 2e-6 for e in np.eye(4)]
    assert loss(final) < loss(start) and np.abs(after).max() < 0.2 * np.abs(slope).max()


def test_op3(spark, docs):
    prints = {i: brute_print(t) for i, t in docs.items()}
    near = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = brute_components([*near, *((i, i) for i in prints)])
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows_of(spark, "op3_simhash_near_dedup")} == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}


def test_op4(spark, docs):
    got = {r["doc_id"]: r for r in rows_of(spark, "op4_quality_classifier")}
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_a_rule_ensemble_in_spark_and_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(size=(400, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.7)).astype(float)
    model = quality_classifier.fit_ensemble(x, y, list("abc"))
    assert len(model.rules) > 2
    total = np.full(400, model.intercept)
    for terms, weight in model.rules:
        total += weight * np.logical_and.reduce([x[:, "abc".index(f)] > t if op == ">" else x[:, "abc".index(f)] <= t for f, op, t in terms])
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = [r[0] for r in rows.select(model.score({c: F.col(c) for c in "abc"})).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-total)), atol=1e-9)


def test_tree_paths_end_at_the_best_cut_and_the_lasso_at_its_optimum():
    rng = np.random.default_rng(6)
    x = rng.uniform(size=(500, 1))
    paths = quality_classifier.tree_paths(x, (x[:, 0] > 0.6).astype(float), ["a"], rng)
    assert any(len(p) == 1 and abs(p[0][2] - 0.6) < 0.02 for p in paths)
    held, y = rng.integers(0, 2, (300, 4)).astype(bool), rng.integers(0, 2, 300).astype(float)
    y[held[:, 0]] = 1
    w, b = quality_classifier.lasso_logistic(held, y, 0.01)
    slope = held.T @ (1 / (1 + np.exp(-(held @ w + b))) - y) / 300
    assert np.all(np.where(w == 0, np.abs(slope) <= 0.01 + 1e-4, np.abs(slope + 0.01 * np.sign(w)) < 1e-4))


def test_scores_keep_to_the_share_of_labels(spark):
    """Nine labels of ten are 1; a bound of 20 a class takes most of them away, and their rows count for as many."""
    rows = [(i, " ".join(["word"] * 30)) for i in range(500)]
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(500)], "doc_id long, quality int")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for bound in (20, 10_000):
        (score,) = {round(r["score"], 6) for r in quality_classifier.score(frame, quality_classifier.fit(frame, labels, bound)).collect()}
        assert score == pytest.approx(0.9, abs=0.02)


def test_op7(spark, docs):
    place, want = 0, {}
    for i in sorted(docs):
        ids = np.array([*direct(docs[i]), 0], "<u4")
        want[i] = (place, len(ids), zlib.crc32(ids.tobytes()))
        place += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows_of(spark, "op7_token_files")} == want


def test_op8(spark):
    prints = {}
    for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist():
        notes = np.round(np.clip(np.nan_to_num(np.array([x or 0.0 for x in r["embedding"]], float)), -0.5, 0.5) * 48).astype(int)
        prints[r["vec_id"]] = audio.fingerprint(audio.to_wav(audio._notes()[notes + 24].ravel())).astype(np.int64)
    got = {(r["query"], r["match"]): r for r in rows_of(spark, "op8_audio")}
    asked = [q for q in prints if q % 20 == 0]
    assert {q for q, _ in got} == set(asked)
    want = [(q, m) for q in asked for m in prints if q != m and not np.array_equal(prints[q], prints[m]) and brute(prints[q], prints[m])[0] <= audio.ERRORS]
    assert sum(p in got for p in want) >= 0.9 * len(want)
    assert all(r["bit_errors"] <= audio.ERRORS * r["bits"] for r in got.values())


def test_repeated_ids_long_media_and_extra_columns(spark):
    rng = np.random.default_rng(9)
    long = rng.integers(-(1 << 31), 1 << 31, 20_000).astype(np.int32).tolist()
    rows = [(20, long, "x"), (20, long[100:], "y"), (21, long[5_000:9_000], "z"), (40, [7] * 100, "w"), (41, None, "v")]
    frame = spark.createDataFrame(rows, "id long, print array<int>, key string")
    got = {(r["query"], r["match"], r["offset"]) for r in audio.align(frame, F.coalesce(F.col("id") % 20 == 0, F.lit(False))).collect()}
    assert {(q, m) for q, m, _ in got} >= {(20, 20), (20, 21), (40, 40)} and {o for q, m, o in got if m == 21} == {-5000, -4900}


def test_op9(spark, docs):
    rows = rows_of(spark, "op9_packing")
    n = check_packing(rows, docs.items(), 2048)
    assert n <= -(-sum(len(direct(t)) + 1 for t in docs.values()) // 2048) + 1
    for i, pieces in itertools.groupby(sorted(rows, key=lambda r: (r["doc_id"], r["piece"])), key=lambda r: r["doc_id"]):
        own = list(pieces)
        assert [p["piece"] for p in own] == list(range(len(own))) and [p["start"] for p in own] == [sum(p["length"] for p in own[:k]) for k in range(len(own))]


def test_op10(spark, docs):
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules = quality_rules.learn(table, labels)
    kept = {r["doc_id"] for r in quality_rules.keep_good(table, rules).collect()}
    for r in rows_of(spark, "op10_quality_rules"):
        n, chars, symbols, dups, repeats = brute_counts(docs[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dups, repeats)
        assert r["base_failed"] == (n < 10 or 100 * repeats > 20 * n) and r["kept"] == (r["doc_id"] in kept) and not (r["base_failed"] and r["kept"])


def test_a_list_of_several_rules_and_their_pruning(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(4000, 3))
    bad = (x[:, 0] > 0.9) | ((x[:, 1] > 0.8) & (x[:, 2] > 0.5)) | ((x[:, 1] < 0.1) & (x[:, 2] < 0.2))
    rules = quality_rules.learn_rules(x, bad, list("abc"))
    assert len(rules) >= 3
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    out = F.when(F.lit(False), F.lit(False))
    for r in rules:
        out = out.when(r.column({c: F.col(c) for c in "abc"}), F.lit(not r.keep))
    assert [r[0] for r in rows.select(out.otherwise(F.lit(False))).collect()] == quality_rules.rejects(rules, x, list("abc")).tolist()
    noisy = quality_rules.Rule((("a", ">", 0.9), ("b", ">", 0.2), ("c", ">", 0.2)))
    w = np.ones(4000)
    assert quality_rules._prune(noisy, x, x[:, 0] > 0.9, list("abc"), w).terms == noisy.terms[:1]
    assert quality_rules.learn_rules(x[:2], np.array([True, False]), list("abc")) == []


def test_the_order_of_keeping_and_rejecting_rules_matters():
    """Half of the rows are good for one plain reason; what rejects the rest would reject many of them as well, were it asked first."""
    rng = np.random.default_rng(11)
    x = rng.uniform(size=(6000, 3))
    bad = (x[:, 0] > 0.5) & (x[:, 1] <= 0.6)
    rules = quality_rules.learn_rules(x, bad, list("abc"))
    assert any(r.keep for r in rules) and any(not r.keep for r in rules[[r.keep for r in rules].index(True) :])
    assert (quality_rules.rejects(rules, x, list("abc")) == bad).mean() > 0.99
    hand = [quality_rules.Rule((("a", "<=", 0.5),), keep=True), quality_rules.Rule((("b", "<=", 0.6),))]
    assert np.array_equal(quality_rules.rejects(hand, x, list("abc")), bad) and not np.array_equal(quality_rules.rejects(hand[::-1], x, list("abc")), bad)


def ratios(text):
    """The features of a text, worked out anew from its words and lines."""
    words, lines = (text or "").encode().split(), [x for x in (text or "").split("\n") if x.encode().split()]
    n, chars, symbols, dups, repeats = brute_counts(text or "")
    per = lambda a, b: a / max(b, 1)
    ascii_ = lambda low, high: sum(low <= c <= high for c in (text or ""))
    return {
        "words_log": math.log1p(n), "word_length": per(chars, n), "symbols": per(symbols, chars), "dup_lines": per(dups, len(lines)), "repeats": per(repeats, n), "distinct": per(len(set(words)), n),
        "upper": per(ascii_("A", "Z"), chars), "digits": per(ascii_("0", "9"), chars), "bangs": per((text or "").count("!"), n), "stops": per((text or "").count("."), n), "line_words": per(n, len(lines)),
        "longest_word_log": math.log1p(max(map(len, words), default=0)), "longest_line": per(max((len(x.encode()) for x in lines), default=0), chars),
    }


def test_op4_and_op10_recomputed_from_the_texts(spark, docs):
    """Scores and verdicts of the registered queries from ratios and models evaluated rule by rule in Python."""
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model, rules = quality_classifier.fit(table, learnable(labels, 5, 0)), quality_rules.learn(table, labels)
    scores = {r["doc_id"]: r["score"] for r in rows_of(spark, "op4_quality_classifier")}
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in rows_of(spark, "op10_quality_rules")}
    holds = lambda terms, f: all(f[n] > t if op == ">" else f[n] <= t for n, op, t in terms)
    for i, text in docs.items():
        f = ratios(text)
        total = model.intercept + sum(w for terms, w in model.rules if holds(terms, f))
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6), i
        first = next((r for r in rules if holds(r.terms, f)), None)
        assert kept[i][1] == (not kept[i][0] and (first is None or first.keep)), i


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, fp int, epoch int, row int"
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) for i in range(12))
    rows = [(1, text, "en", "src0", 10, 1, 2, 3), (1, text, "en", "src0", 10, 1, 2, 3), (2, None, None, None, None, None, None, None), (None, text + " more", "de", "src1", 5, 0, 0, 0)]
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, docs in (("some", rows), ("none", [])):
        now = spark.createDataFrame(docs, kind)
        for step, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{name}-{step}")
            now = spark.read.parquet(f"{tmp_path}/{name}-{step}")
            if step != "packing":
                assert now.columns == [c.split()[0] for c in kind.split(", ")]
        assert (now.count() > 0) == (name == "some")


def test_very_long_texts(spark):
    """Half a million words: one row goes through every operator that reads texts."""
    text = " ".join(f"w{i % 9973} x{i % 31}." for i in range(250_000))
    docs = spark.createDataFrame([(1, text), (2, text[:-9]), (3, "")], "doc_id long, text string")
    scored = docs.select("doc_id", toxicity.toxicity("text", toxicity.Model({"x1": 1.0}, -5.0)).alias("t")).collect()
    assert all(0 <= r["t"]["score"] <= 1 for r in scored)
    counted = {r["doc_id"]: r["quality"] for r in quality_rules.judge(docs, []).collect()}
    assert counted[1]["n_words"] == 500_000 and counted[3]["base_failed"]
    from lodestrata.llm import line_dedup, simhash

    assert Counter(r["component_id"] for r in simhash.near_classes(docs, 5, 0.8).collect()) == {1: 2, 3: 1}
    assert line_dedup.dedup(docs).count() == 3
