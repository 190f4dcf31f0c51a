import hashlib
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrata.llm import alignment, common
from lodestrata.llm.queries import QUERIES

ALPHABET = alignment.byte_alphabet()
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def groups_of(text, a_model, b_model):
    """Groups (A ids, B ids) of one text, token by token."""
    if not text:
        return []
    a = [(i, bytes(ALPHABET[c] for c in a_model.id_to_token(i))) for i in a_model.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b_model.id_to_piece(i)) for i in b_model.encode(text))]
    if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
        return []
    out, i, j, a_end, b_end = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if a_end <= b_end and i < len(a):
            out[-1][0].append(a[i][0])
            a_end += len(a[i][1])
            i += 1
        else:
            out[-1][1].append(b[j][0])
            b_end += len(b[j][1])
            j += 1
        if a_end == b_end and (i < len(a) or j < len(b)):
            out.append(([], []))
    return out


def brute(texts):
    paths = alignment.default_models()
    a_model, b_model = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a_model.encode_special_tokens = True
    groups = [groups_of(t, a_model, b_model) for t in texts]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in groups]
    count = Counter(p for c in links for p in c)
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for g, c in zip(groups, links, strict=True):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        figures = (sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in c.items()))
        out.append((*figures, hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


ODD = ["", None, "a", " ", "  two  spaces ", "\n\nlines\n", "tab\tand\r\n", "U+2581 ▁ inside", "<0x41> <s>", "<|endoftext|> as text", "naïve ﬁne Ａ wide", "日本語のテキスト", "😀😀 emoji 👩‍👩‍👧", "é combined", " no break em", "#" * 300, "x1y2z3" * 80, "\x00\x01 control", "https://example.com/a?b=c&d=%20e"]


def test_odd_texts_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    texts = [*ODD, *ODD[:3], *("".join(rng.choice("ab é\n日😀_9") for _ in range(rng.randint(1, 60))) for _ in range(150))]
    rows = spark.createDataFrame([(i if i != 5 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pair string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in NAMES[:-1]) for r in alignment.linked(rows).collect()}
    want = {i if i != 5 else None: w[:-1] for i, w in enumerate(brute(texts))}
    assert got == want and got[7] == (0,) * 6 and sum(v[0] > 0 for v in got.values()) > 100


@pytest.mark.parametrize("links", [50, 500])
def test_portions_in_several_rows(links, monkeypatch):
    """Ranges of A ids and wide groups give the same pairs as one row does."""
    import numpy as np
    import pyarrow as pa

    texts = pa.array([t or "" for t in ODD] * 2)
    p = alignment.align(texts, *alignment.default_models())
    monkeypatch.setattr(alignment, "LINKS", links)
    monkeypatch.setattr(alignment, "WIDE", 4)
    ranges = alignment._ranges(p)
    parts = [np.stack(alignment._text_pairs(p, low, high)) for low, high in ranges]
    got = {tuple(c[:3]): c[3] for c in np.concatenate(parts, 1).T.tolist()}
    monkeypatch.setattr(alignment, "WIDE", 1 << 40)
    whole = {tuple(c[:3]): c[3] for c in np.stack(alignment._text_pairs(p, 0, 1 << 20)).T.tolist()}
    assert got == whole and len(ranges) > 1 and sum(x.shape[1] for x in parts) == len(whole)


def test_documents_in_several_rows(spark, monkeypatch):
    """With a low bound in the workers' own module the rows of a portion are added up again."""
    each = alignment._stored(*alignment.default_models(), None)

    def low(batches):
        alignment.LINKS = 200
        try:
            yield from each(batches)
        finally:
            alignment.LINKS = 4_000_000

    texts = [t for t in ODD for _ in range(3)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    monkeypatch.setattr(alignment, "_stored", lambda a, b, extra: low)
    got = {r["doc_id"]: tuple(r[c] for c in NAMES[:-1]) for r in alignment.linked(rows).collect()}
    assert got == {i: w[:-1] for i, w in enumerate(brute(texts))}


def test_memory_does_not_grow_with_portions(spark, monkeypatch, tmp_path):
    """In one task: the table of portions has row groups of few rows, also after rows of little, and no aggregate holds the counts of several portions."""
    each = alignment._stored(*alignment.default_models(), None)

    def low(batches):
        alignment.PORTION = 20_000
        try:
            yield from each(batches)
        finally:
            alignment.PORTION = 1 << 20

    rng = random.Random(5)
    texts = [*["a"] * 3, *(" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(3_000)) for _ in range(150))]
    monkeypatch.setattr(alignment, "_stored", lambda a, b, extra: low)
    monkeypatch.setattr(alignment, "ROW_GROUP", 200_000, raising=False)
    monkeypatch.setattr(common, "scratch_dir", lambda spark: str(tmp_path))
    found = alignment.linked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    assert found.count() == len(texts)
    (path,) = tmp_path.glob("aligned-*/*.parquet")
    meta = pq.ParquetFile(path).metadata
    assert meta.num_rows >= 150 and max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) <= 20
    assert "collect_list" not in found._jdf.queryExecution().toString()


def test_lists_of_groups(spark):
    rows = spark.createDataFrame([(1, "Some words, and 12345."), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in alignment.aligned(rows).collect()}
    paths = alignment.default_models()
    a_model, b_model = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    want = groups_of("Some words, and 12345.", a_model, b_model)
    assert got[1]["a"] == [i for x, _ in want for i in x] and got[1]["b"] == [i for _, y in want for i in y]
    assert got[1]["a_in_group"] == [len(x) for x, _ in want] and got[1]["b_in_group"] == [len(y) for _, y in want] and got[2]["a"] == []
    assert alignment.linked(rows.limit(0)).collect() == [] and alignment.aligned(rows.limit(0)).collect() == []


def test_a_very_long_text(spark):
    text = " ".join(f"word{i % 997}" for i in range(200_000))
    (row,) = alignment.linked(spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("n_a", F.lit("clash"))).collect()
    assert row["n_links"] >= row["n_a"] > 200_000 and row["n_best"] == row["count_sum"] == row["n_links"]


def test_op13(spark):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    want = {r["doc_id"]: w for r, w in zip(rows, brute([r["text"] for r in rows]), strict=True)}
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in QUERIES["op13_alignment"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want
