import random

import corpus_pipeline


def test_stages_run_on_all_that_the_one_before_kept(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    text = lambda n: "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(n))
    rows = [(i, text(8), "en", f"src{i % 4}") for i in range(60)]
    rows += [(60 + i, rows[i][1], "en", "src0") for i in range(5)]  # copies
    rows += [(70 + i, "### $$$ %%% " * 20, "de", "src1") for i in range(10)]  # junk
    rows += [(90, None, "en", "src1"), (91, "", None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(70 + i, 0, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, left = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, str(tmp_path))
        after.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
        if name != "packing":
            assert now.columns == docs.columns
    assert left["quality_rules"] == set(range(65))
    assert left["line_dedup"] == set(range(65))  # texts of copies are empty now
    assert left["simhash_near_dedup"] == set(range(61))
    assert left["mixing"] <= left["simhash_near_dedup"] and left["packing"] == left["mixing"]
    want = sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in now.collect())
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_near_copies_that_differ_in_many_bits(spark):
    """Two changed words of 150 leave a similarity over 0.8, and more than two bits differ in most such pairs."""
    rng = random.Random(4)
    rows = []
    for i in range(0, 40, 2):
        w = [f"w{rng.randrange(5000)}" for _ in range(150)]
        v = list(w)
        v[40] = v[90] = "other"
        rows += [(i, " ".join(w)), (i + 1, " ".join(v))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == list(range(0, 40, 2))
