import random
import re

import pytest
import xxhash

from lodestrata.llm import components, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(edges):
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in root}


@pytest.mark.parametrize("text", ["", " \n", "One", "ONE two", "a b c", "Ä ß a\tb\x0bC " * 30, "x y z " * 5000 + "é"])
def test_fingerprint_by_definition(text):
    assert simhash.fingerprint(text.encode()) % (1 << 64) == brute_print(text)


@pytest.mark.parametrize("limit", [64, 3])
def test_classes_against_all_pairs(spark, monkeypatch, limit):
    """With a limit of 3 nearly all links come the other way, through one-bit neighbours."""
    monkeypatch.setattr(simhash, "LIST", limit)
    rng = random.Random(5)
    base = [rng.choices([f"w{i}" for i in range(300)], k=120) for _ in range(12)]
    texts = []
    for w in base:
        for _ in range(12):
            v = list(w)
            for _ in range(rng.randrange(3)):
                v[rng.randrange(len(v))] = rng.choice(["x", "y", "z"])
            texts.append(" ".join(v))
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, " "), (None, texts[0]), (7, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["id"], r["fp"], r["component_id"]) for r in simhash.classes(docs).collect()), key=str)
    prints = {i: brute_print(t) for i, t in rows if i is not None}
    near = [(a, b) for a in prints for b in prints if a <= b and bin(prints[a] ^ prints[b]).count("1") <= 2]
    want = brute_components(near)
    assert got == sorted(((i, (p := brute_print(t)) - (1 << 64 if p >> 63 else 0), want[0 if i is None else i]) for i, t in rows), key=str)
    kept = simhash.keep_one(docs).collect()
    ids = sorted(r["doc_id"] for r in kept if r["doc_id"] is not None)
    assert ids == sorted(set(want.values())) and sum(r["doc_id"] is None for r in kept) == 1


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, fp string, id int")
    assert simhash.classes(empty).count() == 0
    assert simhash.keep_one(empty).columns == empty.columns
    one = spark.createDataFrame([(1, "a b c d", "p", 9), (2, "a b c d", "q", 8)], "doc_id long, text string, fp string, id int")
    assert [tuple(r) for r in simhash.keep_one(one).collect()] == [(1, "a b c d", "p", 9)]


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(5, 5), (1, 2), (2, 1), (1, 2), (None, 4)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(80)]
    rng.shuffle(edges)
    frame = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(frame).collect()}
    assert got == brute_components([(u, v) for u, v in edges if u is not None and u != v])
    assert components.components(frame.limit(0)).count() == 0


def test_similar_texts_against_all_pairs(spark):
    """Chains, a crowd around one text and a passage that all have, held against the similarity of all pairs; most differ in more than two bits."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    passage, texts = " ".join(rng.choices(vocabulary, k=12)), []
    for group in range(14):
        w = rng.choices(vocabulary, k=rng.choice([6, 60, 150, 400]))
        for _ in range(40 if group == 0 else 8):
            v = list(w)
            for _ in range(rng.randrange(4)):
                v[rng.randrange(len(v))] = rng.choice(["x", "y", "z"])
            texts.append(" ".join(v) + (f" {passage}" if group % 2 else ""))
            w = v if group % 3 == 1 else w  # a chain
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "one two"), (903, "One  TWO"), (None, texts[0]), (7, texts[60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def shingles(text):
        w = WORD.findall((text or "").translate(LOWER))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i][1] == sets[j][1] or len(sets[i][1] & sets[j][1]) >= 0.8 * len(sets[i][1] | sets[j][1]) - 1e-9]
    prints = [brute_print(t) for _, t in rows]
    assert sum(bin(prints[i] ^ prints[j]).count("1") > 2 for i, j in pairs) > len(pairs) / 3
    root = brute_components(pairs + [(i, i) for i in range(len(rows))])
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root[i]] = min(doc, least.get(root[i], doc))
    got = sorted(((r["id"], r["component_id"]) for r in simhash.near_classes(docs, 5, 0.8).collect()), key=str)
    assert got == sorted(((doc, least[root[i]]) for i, (doc, _) in enumerate(rows)), key=str)
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs, words=5, similarity=0.8).collect() if r["doc_id"] is not None)
    assert kept == sorted(set(least.values()))
    assert simhash.keep_one(docs.limit(0), words=5, similarity=0.8).count() == 0
