import random

import numpy as np
import pytest

from quantloom.llm import langid

WORDS = {
    "aa": ["ther", "whin", "shal", "owt"],
    "bb": ["çeua", "ñola", "ría", "elq"],
    "cc": ["üsch", "zung", "keit", "dern"],
}


def corpus(n=240):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = rng.choice([*WORDS])
        text = " ".join("".join(rng.choices(WORDS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 40)))
        rows.append((i, text.title(), lang, "s"))
    return rows


def test_held_out_accuracy_and_edge_cases(spark):
    rows = [*corpus(), (1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "123 !!", "bb", "s"), (1003, "ther whin", None, "s"), (1004, "Ther whin " * 150000, "aa", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == len(rows)
    want = {i: lang for i, _, lang, _ in rows}
    tested = [i for i, r in got.items() if r.held_out and i < 1000]
    assert tested and np.mean([got[i].lang_pred == want[i] for i in tested]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}
    assert got[1003].lang_pred == got[1004].lang_pred == "aa"
    kept = {r.doc_id for r in langid.accept(docs).collect()}
    assert kept.isdisjoint({1000, 1001, 1002}) and len(kept) > 230


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(docs).collect()] == ["und"]
    assert langid.identify(docs.limit(0)).collect() == []


def test_presence_equals_plain_ngrams():
    a, b = (" " + t + " " for t in ("abca", "bcab"))
    grams = lambda t: {t[i : i + n] for n in langid.GRAMS for i in range(len(t) - n + 1)}
    x = langid.presence(["abca", "BCAB!"])
    assert x[0] @ x[1] == len(grams(a) & grams(b)) and x[0].sum() == len(grams(a))


UNLEARNED = ["прив етст вует мир", "ανθρ ωπος λογ", "qzx vkj xqw jjz", "日本語の文章です", "ñola ría çeua elq"]


@pytest.mark.parametrize("langs", [["aa"], ["aa", "cc"], ["aa", "bb", "cc"]])
def test_unlearned_languages_go_and_short_clean_texts_stay(spark, langs):
    rng = random.Random(6)
    rows = [(i, t, v, "s") for i, t, v, _ in corpus(400) if v in langs]
    clean = [(1000 + k, w.title(), None, "s") for k, w in enumerate(w for v in langs for w in WORDS[v])]
    clean += [(2000, "Ther whin " * 40 + "".join(WORDS[langs[-1]]) * 60, None, "s")]
    other = [t for t in UNLEARNED if "bb" not in langs or "ñ" not in t]
    strange = [(3000 + k, " ".join(rng.choices(t.split() if " " in t else [*t], k=30)), None, "s") for k, t in enumerate(other)]
    docs = spark.createDataFrame([*rows, *clean, *strange], "doc_id long, text string, lang string, source string")
    assert sorted(r.doc_id for r in langid.accept(docs).collect()) == [r[0] for r in [*rows, *clean]]
