import random
import re

import numpy as np
import pytest

from quantloom.llm import ngram_join as nj


def brute(rows, num=4, den=5):
    sets, comp = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").encode().lower().decode())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        comp[i] = i

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed, n=140):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    shared = [rng.choice(vocab) for _ in range(30)]
    texts = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.55 and texts:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 4)):
                if words:
                    k = rng.randrange(len(words))
                    words[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [words[k], "x"]])
        elif kind < 0.75:
            words = shared + [rng.choice(vocab) for _ in range(rng.randint(0, 12))]
        else:
            words = [rng.choice(vocab) for _ in range(rng.randint(0, 90))]
        texts.append(" ".join(words))
    rows = [*enumerate(texts)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One\x0btwo THREE"), (n + 4, "one two three"), (n + 5, "É é"), (n + 6, "é é"), (n + 7, "z " * 30000), (n + 8, "z " * 29000)]


@pytest.mark.parametrize(("seed", "small", "hot", "block", "plain"), [(1, 3, 1 << 18, 20000, 1 << 20), (2, 1, 64, 20000, 0), (3, 2, 1 << 18, 7, 1 << 20), (4, 8, 1 << 18, 500, 1 << 20)])
def test_matches_brute_force(spark, monkeypatch, seed, small, hot, block, plain):
    from quantloom.llm import components

    monkeypatch.setattr(components, "PLAIN", plain)
    for k, v in (("SMALL_LIST", small), ("HOT_TOKENS", hot), ("BLOCK", block)):
        monkeypatch.setattr(nj, k, v)
    rows = corpus(seed)
    docs = spark.createDataFrame([(t, i, "en", 1, "b") for i, t in rows], "text string, doc_id long, n string, rep int, digest string")
    got = sorted(map(tuple, nj.near_duplicates(docs).collect()))
    assert got == brute(rows)


def test_empty_table(spark):
    assert nj.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_prefixes_are_long_enough():
    rule = nj._Rule(4, 5)
    for n in range(1, 60):
        for m in range(n, 60):
            if not bool(rule.sizes(np.int64(n), np.int64(m))):
                continue
            need = -(-4 * (n + m) // 9)
            assert m - need + 1 <= rule.prefix(m) and n - need + 1 <= rule.index(n)
            assert min(m, m - need + 3) <= rule.prefix(m, 3) and min(n, n - need + 3) <= rule.index(n, 3) and rule.need(n, m, 3) == min(3, need)
            assert n - need + 2 <= n - (-(-n * 4 // 5)) + 2


def test_bitmaps_bound_the_overlap_from_above():
    rng = np.random.default_rng(1)
    for n, m, same in ((5, 6, 4), (30, 28, 25), (400, 380, 100), (40000, 38000, 36000)):
        pool = rng.integers(0, 1 << 64, n + m - same, dtype=np.uint64)
        x, y = np.unique(pool[:n]), np.unique(pool[n - same :])
        bx, by = (np.frombuffer(nj.bitmap(s), np.uint8) for s in (x, y))
        w = min(len(bx), len(by))
        bound = nj.most_common(len(x), nj.fold(bx, w), np.array([len(y)]), nj.fold(by, w)[None])[0]
        assert len(np.intersect1d(x, y)) <= bound <= min(n, m)


def test_repeated_rows_texts_of_one_id_and_caller_settings(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(9, a), (9, a), (9, b), (4, b + " end"), (11, a + " end"), (None, a), (None, None), (7, "")]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    got = sorted(map(tuple, nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(9, 36, 4), (9, 36, 4), (9, 36, 4), (4, 37, 4), (11, 37, 4), (None, 36, 4), (None, 0, None), (7, 0, 7)], key=str)
    assert spark.conf.get(key) == before
