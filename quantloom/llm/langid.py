"""Language identification with string kernels.

A text is the set of its character 1- to 4-grams (lower-cased letters, other runs as one space): the
blended-spectrum presence kernel of two texts is the number of n-grams that both have, divided by
the root of the product of their own numbers. Kernel ridge regression, one language against the
rest, is solved on Nyström features of landmark texts, drawn alike from every language; a block of
texts is scored by two matrix products (texts by landmarks, landmarks by languages).

Scores compare the learned languages with each other and say little on a text in none of them. What
rejects those is each language's own model of characters (three at a time): a text whose mean log
probability in its best language is far under what texts of that language reach is in an unknown one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import CHUNK_BYTES, chunks, has_letter, mix, quoted, strings

GRAMS = (1, 2, 3, 4)
#: Hashed n-grams: a presence vector has so many places.
DIMS = 1 << 14
#: The bounded training sample and the landmarks, for each language; longest texts are used whole.
SAMPLE_PER_LANG, LANDMARKS_PER_LANG = 400, 24
RIDGE = 1e-3
UNDETERMINED = "und"
#: Places for counts of 1, 2 and 3 characters, and the parts that they and an unseen character have in a probability.
SEEN, PARTS = (1 << 16, 1 << 16, 1 << 17), (0.0999, 0.3, 0.6, 0.0001)
#: How many standard deviations under its language's mean a text may be.
STRANGE = 8.0
#: Characters that are in one language, where a text changes between learned ones.
BLOCK = 32
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SALT = np.random.default_rng(23).integers(0, 1 << 64, len(GRAMS), dtype=np.uint64) | np.uint64(1)


def _codes(piece: str) -> np.ndarray:
    """Characters of a piece of text: lower-cased letters, other runs (and both ends) as one space."""
    return np.frombuffer((" " + _NOT_LETTERS.sub(" ", piece).lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def presence(texts: list[str]) -> np.ndarray:
    """A row of 0 and 1 for each text: which hashed n-grams it has."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for row, text in enumerate(texts):
        for begin in range(0, max(1, len(text)), CHUNK_BYTES):  # n-grams over the seam belong to the next piece
            piece = text[max(0, begin - max(GRAMS)) : begin + CHUNK_BYTES]
            codes = _codes(piece)
            acc = np.zeros(len(codes), np.uint64)
            for n in range(1, max(GRAMS) + 1):
                if len(codes) < n:
                    break
                acc = acc[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
                out[row, (acc * _SALT[n - 1]) >> np.uint64(64 - DIMS.bit_length() + 1)] = 1
    return out


def _places(text: str) -> Iterator[list[np.ndarray]]:
    """For pieces of a text, the hashed places of 1, 2 and 3 characters that end at each place but the first."""
    for begin in range(0, max(1, len(text)), CHUNK_BYTES):
        codes = _codes(text[begin : begin + CHUNK_BYTES])
        acc, out = np.zeros(len(codes), np.uint64), []
        for n, size in enumerate(SEEN):
            acc = codes if n == 0 else acc[:-1] * np.uint64(0x100000001B3) + codes[n:] + np.uint64(1)
            out.append((acc % np.uint64(size) if n == 0 else (acc * _SALT[n]) >> np.uint64(65 - size.bit_length())).astype(np.int64))
        yield out


class Characters:
    """Interpolated probabilities of a character after the two before it, and the range that a language's texts have."""

    def __init__(self, texts: list[str]):
        self.counts = [np.zeros(size, np.float32) for size in SEEN]
        for text in texts:
            for found in _places(text):
                for count, at in zip(self.counts, found, strict=True):
                    count += np.bincount(at, minlength=len(count))
        self.total = max(1.0, float(self.counts[0].sum()))
        self.mean, self.spread, self.inner = 0.0, 1.0, 1.0

    def logs(self, text: str) -> Iterator[np.ndarray]:
        """Log probabilities of a text's characters, piece by piece."""
        one, two, three = self.counts
        for a, b, c in _places(text):
            if len(c):
                p = PARTS[0] * one[a[2:]] / self.total + PARTS[1] * np.minimum(1, two[b[1:]] / np.maximum(1, one[a[1:-1]]))
                yield np.log(p + PARTS[2] * np.minimum(1, three[c] / np.maximum(1, two[b[:-1]])) + PARTS[3] / len(one), dtype=float)

    def measure(self, text: str) -> tuple[int, float, float]:
        """Number of characters, mean and variance of their log probabilities."""
        n, total, squares = 0, 0.0, 0.0
        for p in self.logs(text):
            n, total, squares = n + len(p), total + p.sum(), squares + (p * p).sum()
        mean = total / max(1, n)
        return n, mean, max(0.0, squares / max(1, n) - mean * mean)

    def allows(self, n: int, over: float) -> bool:
        """Whether ``n`` characters may have a mean that is ``over`` the language's; short texts vary more (neighbours share characters: a third counts)."""
        return not n or over >= -STRANGE * np.sqrt(self.spread**2 + 3 * self.inner / n)


def characters(texts: list[str]) -> Characters:
    """A language's model; its texts' range is measured on either half by a model of the other."""
    out = Characters(texts)
    halves = [(Characters(texts[1::2]), texts[::2]), (Characters(texts[::2]), texts[1::2])] if len(texts) > 1 else [(out, texts)]
    found = np.array([m.measure(t) for m, own in halves for t in own])
    found = found[found[:, 0] > 0]
    if len(found):
        out.mean, out.inner = float(np.median(found[:, 1])), float(np.median(found[:, 2]))
        out.spread = max(0.05, 1.4826 * float(np.median(np.abs(found[:, 1] - out.mean))))
    return out


@dataclass
class Model:
    """Landmarks (unit rows), their ridge weights for each language, the languages, and their characters."""

    landmarks: np.ndarray
    weights: np.ndarray
    langs: list[str]
    characters: list[Characters]

    def scores(self, texts: list[str]) -> np.ndarray:
        x = presence(texts)
        kernel = x @ self.landmarks.T / np.sqrt(np.maximum(1, x.sum(1)))[:, None]
        return kernel @ self.weights[:-1] + self.weights[-1]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score (0 to 1: one half is the boundary of a language against the rest)."""
        ask = [i for i, t in enumerate(texts) if has_letter(t)]
        lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if ask and self.langs:
            s = self.scores([texts[i] for i in ask])
            for i, k, v in zip(ask, s.argmax(1), s.max(1), strict=True):
                lang[i], score[i] = self.langs[k], float(np.clip(0.5 + v / 2, 0, 1))
        return lang, score

    def known(self, texts: list[str], lang: list[str]) -> list[bool]:
        """Whether each text is one of its language ``lang``, or of learned ones by turns; `und` is not."""
        own = dict(zip(self.langs, self.characters, strict=True))
        return [k in own and self._knows(own[k], t) for t, k in zip(texts, lang, strict=True)]

    def _knows(self, own: Characters, text: str) -> bool:
        n, mean, _ = own.measure(text)
        if own.allows(n, mean - own.mean):
            return True
        total = 0.0  # of every BLOCK characters in the language that fits them best
        for pieces in zip(*(m.logs(text) for m in self.characters), strict=True):
            at = np.arange(0, len(pieces[0]), BLOCK)
            total += np.max([np.add.reduceat(p - m.mean, at) for p, m in zip(pieces, self.characters, strict=True)], axis=0).sum()
        return own.allows(n, total / n)


def fit(texts: list[str], langs: list[str]) -> Model:
    """Kernel ridge regression on Nyström features: landmarks are each language's first samples."""
    names = sorted(set(langs))
    if not names:
        return Model(np.empty((0, DIMS), np.float32), np.empty((1, 0), np.float32), [], [])
    x = presence(texts)
    x /= np.sqrt(np.maximum(1, x.sum(1)))[:, None]
    label = np.array([names.index(v) for v in langs])
    chosen = np.concatenate([np.flatnonzero(label == k)[:LANDMARKS_PER_LANG] for k in range(len(names))])
    land = x[chosen]
    kernel, inner = (x @ land.T).astype(float), (land @ land.T).astype(float)
    value, vector = np.linalg.eigh(inner)
    good = value > 1e-6 * max(1.0, value.max())
    root = vector[:, good] / np.sqrt(value[good])  # kernel @ root: the Nyström features
    z = np.column_stack([kernel @ root, np.ones(len(x))])
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1 / np.bincount(label, minlength=len(names))[label]  # each language counts alike
    zw = z * weight[:, None]
    solved = np.linalg.solve(z.T @ zw + RIDGE * np.eye(z.shape[1]), zw.T @ target)
    own = [characters([t for t, v in zip(texts, langs, strict=True) if v == k]) for k in names]
    return Model(land, np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32), names, own)


def held_out():
    """Rows that no model learns from: crc32 of doc_id as text, a fifth of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Learn from a bounded sample: of each language ``per_lang`` documents that aren't held out.

    The sample is the rows with the smallest hashes of doc_id and text. Languages are counted first,
    and each gets a hash bound that about half as many again are under; so no row is shuffled, and the
    driver gets some 600 texts for each learned language.
    """
    spread = 1 << 30
    named = docs.where(~held_out()).where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    rows = named.select(F.col("lang").cast("string").alias("lang"), "text", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(spread)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample: dict[str, list] = {}
    missing, share = set(counts), 1.5
    while missing:
        bound = {v: min(spread, int(spread * (share * per_lang + 50) / counts[v])) for v in missing}
        picked = F.create_map(*(F.lit(x) for v in sorted(bound) for x in (v, bound[v])))
        found: dict[str, list] = {v: [] for v in missing}
        for r in rows.where(F.col("h") < picked[F.col("lang")]).collect():
            found[r["lang"]].append((r["h"], r["text"]))
        sample |= {v: sorted(x)[:per_lang] for v, x in found.items()}
        missing = {v for v in missing if len(sample[v]) < min(per_lang, counts[v]) and bound[v] < spread}
        share *= 2
    return fit([t for v in sorted(sample) for _, t in sample[v]], [v for v in sorted(sample) for _ in sample[v]])


def predictor(spark, model: Model, known: bool = False):
    """A mapInArrow function that appends lang_pred, score and, if asked, known to its rows (text is read, nothing else)."""
    sent = spark.sparkContext.broadcast(model)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column("text"))
            for part in chunks([len(t) + 16384 for t in texts], 4 << 20):
                lang, score = sent.value.predict(texts[part])
                own = batch.slice(part.start, part.stop - part.start)
                new = {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}
                if known:
                    new["known"] = pa.array(sent.value.known(texts[part], lang), pa.bool_())
                yield pa.RecordBatch.from_arrays([*own.columns, *new.values()], [*own.schema.names, *new])

    return of


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Predict the language of every text: doc_id, held_out, lang_pred, score.

    Learned languages are the non-null values of lang; a repeated row counts as often as it is there, a null
    doc_id is not held out; without any, all predictions are `und`. Null
    texts and texts without a letter are `und` with score 0. Equal texts get equal predictions; lang,
    source and doc_id are no inputs. An empty table gives an empty table.
    """
    model = model or train(docs)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    out = rows.mapInArrow(predictor(docs.sparkSession, model), "doc_id long, held_out boolean, text string, lang_pred string, score double")
    return out.drop("text")


def accept(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """The documents whose language is known: `und`, scores under ``min_score`` and texts that no learned language allows go. Columns as they were."""
    named = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), "text")
    schema = T.StructType([T.StructField("row", docs.schema)]).add("text", "string").add("lang_pred", "string").add("score", "double").add("known", "boolean")
    out = named.mapInArrow(predictor(docs.sparkSession, train(docs), known=True), schema)
    good = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score) & F.col("known")
    return out.where(good).select(*(F.col("row")[c].alias(c) for c in docs.columns))
