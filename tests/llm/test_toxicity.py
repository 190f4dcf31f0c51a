import random

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import toxicity


def corpus(n=500, seed=0):
    rng = random.Random(seed)
    plain = ["the", "day", "was", "long", "and", "people", "walked", "home", "slowly", "together"]
    rows = []
    for i in range(n):
        sentences = [" ".join(rng.choices(plain, k=8)) for _ in range(rng.randrange(1, 12))]
        bad = i % 4 == 0
        if bad:
            k = rng.randrange(len(sentences))
            sentences[k] = sentences[k].replace(" ", f" {rng.choice(['grobber', 'grobberung', 'grobberish', 'snarfle'])} ", 1)
        rows.append((i, ". ".join(s.capitalize() for s in sentences) + ".", int(bad)))
    return rows


def test_held_out_documents_and_the_sentence(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 350], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = docs.select("doc_id", "text", toxicity.toxicity("text", model).alias("t")).collect()
    wrong = [r["doc_id"] for r in got if r["doc_id"] >= 350 and (r["t"]["score"] >= 0.3) != (r["doc_id"] % 4 == 0)]
    assert len(wrong) <= 1
    for r in got:
        if r["doc_id"] >= 350 and r["doc_id"] not in wrong:
            found = [r["text"][s["start"] : s["start"] + s["length"]] for s in r["t"]["sentences"]]
            assert all("grobb" in x or "snarfle" in x for x in found) and bool(found) == (r["doc_id"] % 4 == 0)


def test_noisy_or_by_definition():
    model = toxicity.Model({"bad": 3.0, "badn*": 1.0}, -2.0)
    p = lambda z: 1 / (1 + 2.718281828459045**-z)
    score, spans = model.sentences("All is well. This is BAD bad! Badness, too?\nbadn")
    want = 1 - (1 - p(-2)) * (1 - p(1)) * (1 - p(-1)) * (1 - p(-2))
    assert abs(score - want) < 1e-12 and [s[:2] for s in spans] == [(12, 17)]


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, None)]])
def test_without_both_classes_and_odd_rows(spark, labels):
    docs = spark.createDataFrame([(1, "Some text."), (2, None), (3, ""), (None, "x"), (1, "Some text.")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = {(r["doc_id"], r["text"]): r["t"]["score"] for r in docs.withColumn("t", toxicity.toxicity("text", model)).collect()}
    assert scores[2, None] == scores[3, ""] == 0 and all(0 <= s < 0.01 for s in scores.values())
    assert docs.limit(0).select(toxicity.toxicity(F.col("text"), model)).count() == 0
