import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from quantloom.llm import sentencepiece_codec as sc

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def unigram() -> bytes:
    proto = pb.ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    return proto.SerializeToString()


def test_equals_the_library(library):
    rng = random.Random(6)
    own = sc.Codec(PATH)
    words = ["the", "Ofanthedin", "hesh", "reeation", "für", "señal", "don't", "x=1;", "international", "  two", "été", "a" * 30, "(a,b)", "über-alles", "日本", "\n", "1234567"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " ", "   "]) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text), text
        assert own.decode(ids) == text


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="abehinorst 'éñ1.\n", max_size=60))
def test_equals_the_library_on_any_text(text):
    assert sc.codec(PATH).encode([text])[0].tolist() == sentencepiece_library().encode(text)


def sentencepiece_library(kept=[]):  # noqa: B006
    kept = kept or kept.append(sentencepiece.SentencePieceProcessor(model_file=PATH)) or kept
    return kept[0]


@settings(deadline=None, max_examples=150)
@given(st.text(max_size=40).filter(lambda t: sc.MARK not in t))
def test_decoding_gives_the_text_back(text):
    own = sc.codec(PATH)
    assert own.decode(own.encode([text])[0]) == text


def test_best_of_all_segmentations():
    own = sc.Codec(PATH, unigram())
    assert not own.merges
    score = dict(zip(own.ids.tolist(), own.scores.tolist(), strict=True))
    piece = {own.surface[i].decode().replace(" ", sc.MARK): i for i in own.ids.tolist()}

    def best(word):
        if not word:
            return 0.0
        return max((score[piece[word[:n]]] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in piece), default=float("-inf"))

    for word in ("▁theothe", "▁ationer", "reheating"):
        ids = own._search([word])[0]
        assert sum(score[i] for i in ids.tolist()) == best(word)


@pytest.mark.parametrize("merges", [True, False])
def test_parts_are_searched_once(merges, monkeypatch):
    own = sc.Codec(PATH, None if merges else unigram())
    searched = []
    advance = sc.Codec._advance
    monkeypatch.setattr(sc.Codec, "_advance", lambda self, codes, *start: searched.append(codes.size) or advance(self, codes, *start))
    stems = ["alpha", "Brot", "cielo", "heating", "über"]
    text = " ".join(f"{a}{end}\n{b}{mark}" for a in stems for b in stems for end in ".,!" for mark in ("", ".", "&&&", "%%%"))
    ids = own.encode([text])[0]
    assert sum(searched) < 120  # each stem with a mark and without, and what stands between: not 300 words
    assert own.decode(ids) == text and (not merges or ids.tolist() == sentencepiece_library().encode(text))
    searched.clear()
    assert own.encode(["alpha.\nalpha!\nheating"])[0].tolist() and not searched


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="aeinstñÉß.,;!$%&()'\"«…\n\t0129日本が🙂 ", max_size=80))
def test_parts_equal_the_library(text):
    own = sc.Codec.__new__(sc.Codec)
    own.__dict__ = sc.codec(PATH).__dict__ | {"known": {}, "older": {}}
    assert own.encode([text])[0].tolist() == sentencepiece_library().encode(text)


def test_very_long_words_have_few_parts(library):
    rng = random.Random(8)
    own = sc.Codec(PATH)
    for alphabet in ("ab.,\n", "0123456789", "日é!$", "the\n"):
        text = "".join(rng.choices(alphabet, k=20_000))
        begins = own._begins(text, [len(text)])
        assert len(begins) <= 2 + len(text) // sc.CELL + 1
        assert own.encode([text, "x " + text[:3000]])[0].tolist() == library.encode(text)
    words = ["a.b", "".join(rng.choices("ab.", k=5000)), "c", "d\ne"]
    assert [b for b in own._begins("".join(words), [len(w) for w in words]).tolist() if b > 5002] == [5003, 5004, 5005, 5006, 5007]


def test_a_very_long_word_with_rare_cuts_stays_whole(library):
    own = sc.Codec(PATH)
    text = ("theationer" * 300 + ".") * 4 + "and"
    assert own._begins(text, [len(text)]).tolist() == [0, len(text)]
    assert own.encode([text])[0].tolist() == library.encode(text)


@pytest.mark.parametrize("merges", [True, False])
def test_words_of_similar_length_are_searched_together(merges, library, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdeinorst", k=k)) for k in range(1, 1000, 7)]
    own = sc.Codec(PATH, None if merges else unigram())
    alone = [own._search([sc.MARK + w])[0].tolist() for w in words]
    searches = []
    advance = sc.Codec._advance
    monkeypatch.setattr(sc.Codec, "_advance", lambda self, codes, *start: searches.append(len(codes)) or advance(self, codes, *start))
    ids = own.encode([" ".join(words)])[0].tolist()
    assert ids == [x for w in alone for x in w] and len(searches) < 50  # 143 lengths
    assert not merges or ids == library.encode(" ".join(words))


def test_words_of_forgotten_parts(library, monkeypatch):
    monkeypatch.setattr(sc, "WORDS_KEPT", 3)
    own = sc.Codec(PATH)
    for text in ("alpha. beta,\ngamma", "gamma. alpha", "delta! beta.", "alpha.", "beta,\ngamma delta", "beta,\ngamma delta"):
        assert own.encode([text, "", text])[2].tolist() == library.encode(text)


def test_rows_are_decoded_as_one(library):
    own = sc.Codec(PATH)
    texts = ["été 日本\n", "", " two  spaces ", "🙂.", "a" * 100]
    ids = [library.encode(t) for t in texts]
    broken = [own.byte[0xE6].item(), own.byte[0x97].item()]
    lists = pa.array([ids[0], None, ids[1], ids[2], broken, ids[3], [], ids[4]], pa.list_(pa.int32()))
    expected = [texts[0], "", "", texts[2], own.decode(broken), texts[3], "", texts[4]]
    assert list(own.decode_rows(lists)) == expected
    assert list(own.decode_rows(lists.slice(2, 4))) == expected[2:6]
    assert list(own.decode_rows(lists.slice(1, 2))) == ["", ""] and list(own.decode_rows(lists.slice(0, 0))) == []


def test_tables(spark):
    texts = [None, "", " ", "a  b ", "日本語 \n\t x", "word " * 30000, "z" * 5000, "a  b "]
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r for r in sc.round_trip(docs, PATH).collect()}
    assert [got[i].decoded_sha256 for i in range(len(texts))] == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
    assert got[0].n_ids == got[1].n_ids == 0 and got[3].ids == got[7].ids
    back = {r.doc_id: r.text for r in sc.decode(sc.encode(docs, PATH), PATH).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert sc.round_trip(docs.limit(0), PATH).collect() == []
