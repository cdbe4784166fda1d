import random

import pytest
import test_native as native
import test_ngram_join as jaccard
import test_suffix_dedup as substrings

import corpus_pipeline
from quantloom.llm import langid

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def documents(seed):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("th", "er", "on", "an", "re") for b in ("e", "ing", "at", "ous", "is", "ly")]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, licence = line(60), line(15)
    rows = []
    for i in range(120):
        k = rng.random()
        if k < 0.15 and rows:
            text = rng.choice(rows)[1]
        elif k < 0.3 and rows:
            words = (rng.choice(rows)[1] or "").split(" ")
            words[len(words) // 2 : len(words) // 2 + 1] = ["changed"]
            text = " ".join(words)
        else:
            parts = [line(rng.randint(3, 40)) for _ in range(rng.randint(1, 5))]
            if k > 0.8:
                parts.insert(1, licence)
            if k > 0.7:
                parts[0] += " " + passage
            text = "\n".join(parts)
        rows.append((i, text))
    return [*rows, (120, None), (121, ""), (122, "123 456 !!")]


def test_each_stage_against_brute_force(spark):
    rows = documents(9)
    docs = table(spark, rows)
    kept = corpus_pipeline.language(spark, docs, "").collect()
    assert {r.doc_id for r in kept} == {i for i, t in rows if langid.has_letter(t or "")}
    rows = [(r.doc_id, r.text) for r in kept]

    want = native.brute(rows, 10)
    out = corpus_pipeline.lines(spark, table(spark, rows), "")
    assert out.columns == COLUMNS
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {i: (t, len(t)) for i, (t, _) in want.items()}
    rows = sorted((i, t) for i, (t, _) in got.items())

    want = {i for i, _, c in jaccard.brute(rows) if i == c}
    got = corpus_pipeline.near_duplicates(spark, table(spark, rows), "")
    assert got.columns == COLUMNS
    rows = sorted((r.doc_id, r.text) for r in got.collect())
    assert {i for i, _ in rows} == want

    want = {i: gone for i, _, gone, _, _ in substrings.brute(rows)}
    got = {r.doc_id: r for r in corpus_pipeline.passages(spark, table(spark, rows), "").collect()}
    assert sorted(got) == [i for i, _ in rows] and any(want.values())
    assert {i: len((t or "").encode()) - len(got[i].text.encode()) for i, t in rows} == want
    assert all(r.n_chars == len(r.text) for r in got.values())

    rows = [(i, r.text) for i, r in got.items()]
    seqs = corpus_pipeline.packed(spark, table(spark, rows), "").collect()
    assert {r.doc_id for r in seqs} == {i for i, _ in rows}


def test_run_and_empty(spark, tmp_path):
    table(spark, documents(3)).write.parquet(str(tmp_path / "a/documents.parquet"))
    table(spark, []).write.parquet(str(tmp_path / "b/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() > 50
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).collect() == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_null_ids_stay(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(None, "the ering onat"), (None, "the ering onat"), (5, "the ering onat erly")]
    assert len(stage(spark, table(spark, rows), "").collect()) == 3


def test_stages_keep_odd_columns_and_repeated_rows(spark):
    passage = "the ering onat erly thing reat ious is erat theis onous anly " * 3
    rows = [(1, passage + "\nown a one", 1, "x", 3), (2, "else reat " + passage, 2, "y", 4), (2, "else reat " + passage, 2, "y", 4), (3, None, 3, "z", 5), (None, passage, 4, "w", 6)]
    docs = spark.createDataFrame([(i, t, "en", k, v, n) for i, t, k, v, n in rows], "doc_id long, text string, lang string, n_deleted int, `a.b` string, row int")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        got = sorted((str(r.doc_id), r.n_deleted, r["a.b"], r["row"]) for r in out.collect())
        assert got == sorted((str(i), k, v, n) for i, _, k, v, n in rows), name
    texts = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.passages(spark, docs, "").collect())
    assert [t for i, t in texts if i == "2"] == ["else reat"] * 2 and [t for i, t in texts if i == "None"] == [passage]
