import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import suffix_dedup as sd


def brute(rows):
    least = {}
    data = {i: (t or "").encode() for i, t in rows}
    for i in sorted(data):
        for p in range(len(data[i]) - 49):
            least.setdefault(data[i][p : p + 50], i)
    out = []
    for i, b in sorted(data.items()):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "é", "of", "ation", "ing", "日本", "x"]) + rng.choice(["a", "b", "ere", ""])
    passage = [" ".join(word() for _ in range(n)) for n in (12, 20, 60, 9)]
    texts = []
    for _ in range(70):
        parts = []
        for _ in range(rng.randint(1, 6)):
            k = rng.random()
            if k < 0.4:
                s = rng.choice(passage)
                a = rng.randint(0, 20)
                parts.append(s[a : a + rng.randint(30, 300)])
            elif k < 0.5 and texts:
                parts.append(rng.choice(texts))
            else:
                parts.append(" ".join(word() for _ in range(rng.randint(0, 40))))
        texts.append(" ".join(parts)[:3000])
    texts += [None, "", "a" * 49, "a" * 50, "a" * 51, "a" * 400, "ab" * 100, "ab" * 90, "q" * 60, texts[0], texts[0], passage[2]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [*zip(ids, texts, strict=True)]


def run(spark, rows):
    docs = spark.createDataFrame([(t, i, 0, "b") for i, t in rows], "text string, doc_id long, r int, blob string")
    got = sd.remove_repeats(docs).collect()
    return sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_a_hot_passage_crosses_buckets(spark):
    hot = "this passage stands in every one of these documents and is long enough to be found " * 2
    rows = [(i, f"{i * 7919} {hot}{i}") for i in range(300)]
    assert run(spark, rows) == brute(rows)


def test_long_text_spans_segments(spark, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_100_000))
    a = sd.Anchors([long.encode(), b"short", long[500:700].encode()])
    n = sum((h - low + 1) for low, h in zip(a.lo, a.hi, strict=True))
    assert n == len(long) - 49 + 0 + 151
    rows = [(1, long), (0, long[1_040_000:1_060_000])]
    got = run(spark, rows)
    assert got[0][2] == 0 and got[1][2] == 20_000 and got[1][3] == 1


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_multikey_sort():
    rows = np.random.default_rng(0).integers(0, 2, (500, 11), dtype=np.uint8)
    assert [bytes(rows[k]) for k in sd.multikey_sort(rows)] == sorted(map(bytes, rows))


def test_repeated_rows_and_texts_of_one_id(spark):
    import random

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, own = word(120), word(80)
    rows = [(1, shared), (2, own + shared), (2, own + shared), (2, shared + own), (3, own), (None, shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, bytes(r.kept).decode()) for r in sd.remove_repeats(docs).collect()), key=str)
    assert got == sorted([(1, shared), (2, own), (2, own), (2, own), (3, ""), (None, shared)], key=str)
    assert docs.select(F.xxhash64("text").alias("h")).first().h == sd.tag_of(shared.encode())
