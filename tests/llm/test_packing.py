import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from quantloom.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_bins_hold_every_length_once(lengths):
    bins = packing.best_two_fit(np.array(lengths, np.int64), 20)
    assert sorted(x for b in bins for x in b) == sorted(lengths)
    assert all(0 < sum(b) <= 20 for b in bins)
    assert len(bins) <= 2 * -(-sum(lengths) // 20) + 1


def test_two_fit_fills_a_gap():
    # greedy alone: [11, 8], [7, 5, 5] and 3 left over
    assert len(packing.best_two_fit(np.array([11, 8, 5, 4]), 20)) == 2
    assert sorted(map(sum, packing.best_two_fit(np.array([13, 6, 4, 3]), 20)))[-1] == 20


def texts():
    rng = random.Random(1)
    out = [" ".join(rng.choice(["the", "été", "naïve", "日本", "x1", "!!", "don't", "\n\n", "a" * 40]) for _ in range(rng.randint(0, 900))) for _ in range(60)]
    return [*out, None, "", " ", "\n", "<|endoftext|> is text", "word " * 6000, "word " * 6000, "é" * 50000]


@pytest.mark.parametrize("groups", [100_000, 20])
def test_pieces_are_whole_and_sequences_gapless(spark, monkeypatch, groups):
    monkeypatch.setattr(packing, "GROUP", groups)
    rows = [*enumerate(texts())]
    docs = spark.createDataFrame([(i, t, 5, "b") for i, t in rows], "doc_id long, text string, length int, part string")
    got = packing.pack_documents(docs, PATH).collect()
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == [*range(len(own))] and sum(r.length for r in own) == len(ids)
        assert len(own) == -(-len(ids) // 2048)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(by_seq) <= -(-total // 2048) + (2 if groups > 1000 else 8)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_queries_take_special_tokens_as_the_library_does(spark, tmp_path):
    rows = [*enumerate(["a<|endoftext|> is", "<|endoftext|>", "x <|endoftext|><|endoftext|>\n" * 1500, "<|endoftext |> é", "plain text", None])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tok = Tokenizer.from_file(PATH)
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    assert ids[1].tolist() == [50256, 0]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for out in (queries.op3_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, "")):
        got = out.collect()
        assert {i: sum(r.length for r in got if r.doc_id == i) for i in ids} == {i: len(x) for i, x in ids.items()}
        assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in got)


def test_long_white_space_and_large_or_missing_ids(spark):
    big = (1 << 53) + 1
    rows = [(big, "\n" * 2_000_000), (None, " " * 2_000_000 + "x"), (None, None), (7, "a" * 100_000), (7, "twice"), (7, "twice")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    tok = Tokenizer.from_file(PATH)
    want = defaultdict(int)
    for i, t in rows:
        want[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    have = defaultdict(int)
    for r in got:
        have[r.doc_id] += r.length
    assert have == want
    whole = np.array([*tok.encode(rows[0][1], add_special_tokens=False).ids, 0], "<u4")
    assert all(r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes()) for r in got if r.doc_id == big)
