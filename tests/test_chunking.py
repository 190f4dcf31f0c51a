"""Chunks bounded in tokens, with pages, against a plain walk over whole tables."""

import re

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import chunking, documents
from lodestrata.plans.documents import _paged
from lodestrata.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"


def tokens(parts):
    return max(1, len(" ".join(parts)) // 4)


def plain(paragraphs, target=400, overlap=50, hard=512):
    """(text, first page, last page) of the chunks of (text, page) paragraphs under one heading, each rule spelled out anew."""
    done, now = [], []

    def end():
        nonlocal now
        if now:
            done.append((" ".join(t for t, _ in now), now[0][1], now[-1][1]))
        now = []

    def put(text, page):
        nonlocal now
        if now and tokens([t for t, _ in now] + [text]) > target:
            sentences = [(x, p) for t, p in now for x in re.split(r"(?<=[.!?])\s+", t)]
            keep = 0
            while keep < len(sentences) and tokens([x for x, _ in sentences[len(sentences) - keep - 1 :]]) <= overlap:
                keep += 1
            tail = sentences[len(sentences) - keep :]
            end()
            while tail and tokens([x for x, _ in tail] + [text]) > hard:
                tail = tail[1:]
            now = tail
        now.append((text, page))

    for text, page in paragraphs:
        if tokens([text]) <= hard:
            put(text, page)
            continue
        end()
        for sentence in re.split(r"(?<=[.!?])\s+", text):
            words, piece = sentence.split() if tokens([sentence]) > hard else [sentence], []
            for w in words:
                if piece and tokens([*piece, w]) > hard:
                    put(" ".join(piece), page)
                    piece = []
                while tokens([w]) > hard:
                    put(w[: 4 * hard + 3], page)
                    w = w[4 * hard + 3 :]
                piece.append(w)
            put(" ".join(piece), page)
        end()
    end()
    return done


def test_documents_in_chunks_equal_a_plain_walk_over_the_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert len(docs) == 1000
    got = {}
    for r in QUERIES["chunk_documents"](spark, SF).orderBy("doc_id", "chunk").collect():
        got.setdefault(r["doc_id"], []).append((r["tokens"], r["text_hash"]))
        assert r["tokens"] <= 512
    import hashlib

    for i, text in docs.items():
        want = [(tokens([t]), hashlib.sha256(t.encode()).hexdigest()) for t, _, _ in plain([(p.strip(), None) for p in (text or "").split("\n") if p.strip()])]
        assert got.get(i, []) == want, i
    assert sum(map(len, got.values())) > 1000


def test_walk_over_pages_equals_a_plain_walk_over_the_table(spark):
    lines = documents.lines(_paged(spark, SF)).orderBy("doc_id", "page", "at").collect()
    want, doc, chapter, section, under, words, page = {}, None, None, None, [], [], None

    def close():
        nonlocal words
        text = " ".join(words).strip()
        if len(text) > 10:
            under.append((text, page))
        words = []

    def end():
        close()
        want.setdefault(doc, []).extend((chapter, section, a, b, t) for t, a, b in plain(under))
        under.clear()

    for r in lines:
        if r["doc_id"] != doc:
            if doc is not None:
                end()
            doc, chapter, section, page = r["doc_id"], None, None, r["page"]
        if r["page"] != page:
            close()
            page = r["page"]
        if r["chapter"] or r["section"]:
            end()
            chapter, section = (r["chapter"], None) if r["chapter"] else (chapter, r["section"])
        elif r["line"].strip():
            words.append(r["line"].strip())
        else:
            close()
    end()
    got = {}
    for r in documents.walk(_paged(spark, SF)).orderBy("doc_id", "chunk_index").collect():
        assert r["chunk_index"] == len(got.setdefault(r["doc_id"], [])) and r["token_count"] == tokens([r["text"]]) <= 512
        got[r["doc_id"]].append((r["chapter"], r["section"], r["page_start"], r["page_end"], r["text"]))
    assert got == {d: c for d, c in want.items() if c} and len(got) > 50


def test_each_chunk_begins_on_its_own_page(spark):
    body = lambda w: "\n\n".join(f"{w} sentence number {i} goes on for a while, with words enough to fill some tokens. " * 4 for i in range(8))
    pages = [(1, p, body(w)) for p, w in enumerate(["alpha", "beta", "gamma"], 1)]
    rows = documents.walk(spark.createDataFrame(pages, "doc_id long, page_num int, text string")).orderBy("chunk_index").collect()
    assert {r["page_start"] for r in rows} == {1, 2, 3} and all(r["page_start"] <= r["page_end"] for r in rows)
    for r in rows:
        first, last = (next(i for i, w in enumerate(["alpha", "beta", "gamma"], 1) if w in part) for part in (r["text"][:30], r["text"][-100:]))
        assert (r["page_start"], r["page_end"]) == (first, last)


@pytest.mark.parametrize("text", ["w" * 9000, " ".join("x" * n for n in (3000, 5, 2500)), "a. " * 3000, "No end " * 2000, "One. " + "y" * 2100 + ". Two."])
def test_nothing_is_over_the_bound_and_nothing_is_lost(spark, text):
    (row,) = spark.createDataFrame([(text,)], "t string").select(chunking.chunks("t").alias("c")).collect()
    assert all(c["tokens"] <= 512 for c in row["c"])
    assert [c["text"] for c in row["c"]] == [t for t, _, _ in plain([(text.strip(), None)])]
    assert {w for w in text.split() if len(w) <= 2051} <= set(" ".join(c["text"] for c in row["c"]).split()) and sum(len(c["text"]) for c in row["c"]) >= len(text.replace(" ", ""))


def test_another_counter_nulls_and_clashing_names(spark):
    count = lambda t: len(t.split()) or 1
    rows = spark.createDataFrame([("a b c d\n\ne f\n\ng. h i", 1), (None, 2), ("", 3)], "t string, c int").select("c", chunking.chunks("t", target=4, overlap=2, hard=5, count=count).alias("x")).orderBy("c").collect()
    assert [[(c["text"], c["tokens"]) for c in r["x"]] for r in rows] == [[("a b c d", 4), ("e f", 2), ("e f g. h i", 5)], [], []]
    pages = spark.createDataFrame([("d", 1, None, "x"), (None, 1, "some text that is long enough", "x"), ("e", 1, "some text that is long enough", "x")], "doc_id string, page_num int, text string, chapter string")
    ranges = spark.createDataFrame([("e", 2, "Chapter 2. B", 1, 1), ("e", 1, "Chapter 1. A", 1, 3)], "doc_id string, number int, title string, first_page int, last_page int")
    assert [(r["doc_id"], r["chapter"], r["page_start"]) for r in documents.walk(pages, ranges=ranges).collect()] == [("e", "Chapter 1. A", 1)]
    assert documents.walk(pages.limit(0)).collect() == []


def test_many_ranges_of_one_key(spark):
    """A hundred thousand ranges of one key: each place is joined to the ranges that hold it and to no others."""
    import random

    rng = random.Random(3)
    ranges = [("k", i * 10, i * 10 + rng.randint(-1, 14), i, f"r{i}") for i in range(100_000)] + [("k", -50, -1, 7, "below"), ("k", -5, 20, 3, "over"), (None, 0, 9, 0, "none"), ("z", 4, 4, 1, "one"), ("z", None, 9, 0, "open")]
    places = [("k", rng.randint(-60, 1_000_030)) for _ in range(3000)] + [("k", None), (None, 5), ("z", 4), ("z", 5), ("q", 1), ("k", 0), ("k", -1), ("k", 0)]
    frame = spark.createDataFrame(ranges, "key string, low long, high long, ord int, v string")
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "i int, key string, at long")
    got = {r["i"]: r["v"] for r in documents.first_range(rows, frame, "key", "at", "low", "high", "ord", "v").collect()}
    by_key = {}
    for k, low, high, order, v in ranges:
        if k is not None and low is not None:
            by_key.setdefault(k, []).append((low, high, order, v))
    for i, (k, at) in enumerate(places):
        own = by_key.get(k, []) if at is not None else []
        near = own if len(own) < 10 else [x for x in [*own[max(0, at // 10 - 3) : max(0, at // 10 + 2)], *own[-2:]]]
        held = [(order, v) for low, high, order, v in near if low <= at <= high]
        assert got[i] == (min(held)[1] if held else None), (k, at)
    assert documents.first_range(rows, frame.limit(0), "key", "at", "low", "high", "ord", "v").filter(F.col("v").isNotNull()).count() == 0


def test_chapters_out_of_texts_equal_a_plain_walk(spark):
    from lodestrata.plans import documents as plans

    seen = {}
    original, plans.D.with_chapters = plans.D.with_chapters, lambda chunks: seen.setdefault("chunks", chunks)
    try:
        plans.chapters_of_chunks(spark, SF)
    finally:
        plans.D.with_chapters = original
    pubs = {}
    for r in seen["chunks"].orderBy("chunk_index").collect():
        pubs.setdefault(r["pub"], []).append(r)
    find = re.compile(documents.CHAPTER_IN_TEXT)
    want = {}
    for pub, rows in pubs.items():
        refs = [(r["page_start"], int(m[1]), m[2].strip()) for r in rows for m in find.finditer(r["text"])]
        starts, known = {}, set()
        for page, number, title in refs:
            if number not in known:
                starts[page] = (True, number, title)
                known.add(number)
            else:
                starts.setdefault(page, (False, number, title))
        labels = {}
        if len(starts) > 1:
            pages = sorted(starts)
            for r in rows:
                before = [p for p in pages if p <= r["page_start"]]
                labels[r["chunk_index"]] = "Chapter {}. {}".format(*starts[before[-1]][1:]) if before else "Introduction"
        if len(set(labels.values())) < 2:
            size = max(20, len(rows) // 6)
            labels = {r["chunk_index"]: "(General)" for r in rows}
            if len(rows) > 30:
                for i in range(0, len(rows), size):
                    part = rows[i : i + size]
                    labels.update({r["chunk_index"]: f"Pages {part[0]['page_start']}–{part[-1]['page_end']}" for r in part})
        want.update({(pub, i): c for i, c in labels.items()})
    got = {(r["pub"], r["chunk_index"]): r["chapter"] for r in QUERIES["chapters_of_chunks"](spark, SF).collect()}
    assert got == want and {c.split()[0] for c in got.values()} >= {"Chapter", "Introduction"}


def test_titled_publications_keep_their_chapters_and_anchors_fit(spark):
    kind = "pub string, chunk_index int, page_start int, page_end int, text string, chapter string, section string, form_refs array<string>"
    rows = [("1", i, i, i, f"Chapter {i % 3 + 1}. Some Title\nmore words", "Own" if i == 2 else "", "S", ["Form1"]) for i in range(5)] + [("2", i, i, i, None, None, None, None) for i in range(40)] + [("3", 0, 1, 1, "text", "", "", [])]
    frame = spark.createDataFrame(rows, kind)
    got = {(r["pub"], r["chunk_index"]): r["chapter"] for r in documents.with_chapters(frame).collect()}
    assert len(got) == 46 and got["1", 2] == "Own" and got["1", 0] == "" and got["3", 0] == "(General)" and got["2", 0] == "Pages 0–19" and got["2", 39] == "Pages 20–39"
    years = spark.createDataFrame([("1", 2024), ("2", 2024)], "pub string, year int")
    long = spark.createDataFrame([("1", i, 1, 1, f"The limit is $1,{i}00 or 7.5%. " + "word " * 300, "One", f"Part {i}", [f"Form{i}", "W-2"]) for i in range(12)], kind)
    (whole,) = documents.chapter_summaries(long, years, tokens=5000).collect()
    lines = whole["text"].split("\n")
    assert lines[0] == "[SECTION SUMMARY] Publication 1 (Tax Year 2024), One" and lines[1].endswith("...") and len(lines[1].split()) == 150 and lines[2] == "Key sections: " + ", ".join(f"Part {i}" for i in range(8))
    assert lines[3] == "Forms: " + ", ".join(sorted(["W-2", *(f"Form{i}" for i in range(12))])[:8]) and lines[4].startswith("Amounts and limits: limit is $1,000, 7.5%, Form0, W-2") and lines[5] == "12 passages."
    (short,) = documents.chapter_summaries(long, years).collect()
    assert short["token_count"] <= 350 and short["text"].startswith("[SECTION SUMMARY]") and "passages." not in short["text"] or short["token_count"] <= 350
    assert documents.chapter_summaries(long.limit(0), years).collect() == []
