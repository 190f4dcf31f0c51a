import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm import audio


def tune(rng, notes=80):
    t = np.arange(audio.HOP) / audio.RATE
    pitch = rng.integers(-18, 18, notes)
    return (0.4 * np.sin(2 * np.pi * 440 * 2 ** (pitch[:, None] / 12) * t)).ravel()


def brute(a, b):
    """The best share of differing bits over all offsets with enough overlap."""
    found = []
    for offset in range(-len(a) + 1, len(b)):
        i, j = max(0, -offset), min(len(a), len(b) - offset)
        if j - i >= audio.OVERLAP:
            x = a[i:j] ^ b[i + offset : j + offset]
            found.append((sum(bin(v & 0xFFFFFFFF).count("1") for v in x.tolist()) / (32 * (j - i)), offset))
    return min(found, default=(1.0, 0))


def test_shifted_noisy_and_foreign_recordings(spark):
    rng = np.random.default_rng(2)
    base = [tune(rng) for _ in range(8)]
    rows = [(20 * i, x) for i, x in enumerate(base)]
    rows += [(20 * i + 1, x[audio.HOP * 5 :]) for i, x in enumerate(base)]
    rows += [(20 * i + 2, x + rng.normal(0, 0.01, len(x))) for i, x in enumerate(base)]
    rows += [(1000 + i, tune(rng)) for i in range(10)] + [(2001, base[0]), (2002, base[0])]
    media = [(i, audio.to_wav(x)) for i, x in rows] + [(3000, None), (3001, b"not audio"), (3020, audio.to_wav(np.zeros(90_000))), (3040, b""), (None, audio.to_wav(base[1]))]
    frame = spark.createDataFrame(media, "id long, media binary").withColumn("print", audio.chroma_print("media"))
    prints = {r["id"]: np.array(r["print"], np.int64) for r in frame.collect()}
    got = {(r["query"], r["match"]): r for r in audio.align(frame, F.coalesce(F.col("id") % 20 == 0, F.lit(False))).collect()}
    want = {(q, m) for q in prints if q is not None and q % 20 == 0 and q < 1000 for m in prints if m is not None and m < 2000 and q != m and brute(prints[q], prints[m])[0] <= audio.ERRORS}
    assert len(want) >= 14
    first = {prints[i].tobytes(): i for i in sorted((i for i in prints if i is not None), reverse=True)}  # a class is named by its smallest id
    assert sum((q, first[prints[m].tobytes()]) in got for q, m in want) >= 0.9 * len(want)
    for (q, m), r in got.items():
        assert q == m or q >= 3000 or brute(prints[q], prints[m])[0] <= audio.ERRORS
        i, n = max(0, -r["offset"]), r["bits"] // 32
        differing = prints[q][i : i + n] ^ prints[m][i + r["offset"] : i + r["offset"] + n]
        assert r["bit_errors"] == sum(bin(v & 0xFFFFFFFF).count("1") for v in differing.tolist())
        if m == q + 1:
            assert r["offset"] == -5
    same = sum(np.array_equal(prints[i], prints[0]) for i in prints)  # the noise may leave a fingerprint as it was
    assert got[0, 0]["copies"] == same >= 3 and got[3020, 3020]["bit_errors"] == 0 and (3040, 3000) in got


def test_other_rates_and_stereo():
    rng = np.random.default_rng(1)
    x = tune(rng)
    import io
    import wave

    sink = io.BytesIO()
    with wave.open(sink, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(2 * audio.RATE)
        fine = np.interp(np.arange(2 * len(x)) / 2, np.arange(len(x)), x)
        w.writeframes((np.column_stack([fine, fine]) * 32767).astype("<i2").tobytes())
    a, b = audio.fingerprint(audio.to_wav(x)), audio.fingerprint(sink.getvalue())
    n = min(len(a), len(b))
    assert abs(len(a) - len(b)) <= 1 and np.bitwise_count((a[:n] ^ b[:n]).view(np.uint32)).sum() < 0.1 * 32 * n


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id long, print array<int>")
    assert audio.align(empty, F.col("id") % 20 == 0).count() == 0


def test_a_noisy_passage_that_all_recordings_share(spark):
    """Each entry of the passage is held by hundreds of recordings, of which no two have 16 equal integers in a row."""
    rng = np.random.default_rng(5)
    passage = rng.integers(-(1 << 31), 1 << 31, 24)
    noise = np.where(rng.random((600, 24)) < 0.3, 1 << rng.integers(0, 31, (600, 24)), 0)
    prints = (passage ^ noise).astype(np.int32)
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(prints)], "id long, print array<int>")
    got = {(r["query"], r["match"]): r["offset"] for r in audio.align(frame, F.col("id") % 100 == 0).collect()}
    want = {(q, m) for q in range(0, 600, 100) for m in range(600) if q == m or brute(prints[q].astype(np.int64), prints[m].astype(np.int64))[0] <= audio.ERRORS}
    assert len(want) == 3600 and set(got) == want and set(got.values()) == {0}
