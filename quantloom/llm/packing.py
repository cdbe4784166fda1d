"""Best-fit packing of tokenized documents into sequences of bounded length.

Documents are tokenized once, where they are; what is dealt out for packing is a few numbers for each
piece. Pieces go to groups of at most about ``GROUP`` by hash (their number is bounded by the bytes), and each group is packed by itself by
best-two-fit: bins are filled greedily with the longest piece that fits, then a bin's smallest piece
is replaced with two unpacked pieces that fit the expanded gap more tightly. A group of that many
pieces leaves at most a few bins unfilled, so the number of groups costs next to nothing.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import chunks, strings, text_size

LENGTH = 2048
SEPARATOR = 0
#: Pieces that one task packs (about as many; a group holds three numbers for each).
GROUP = 100_000
#: ``tiktoken``'s pattern recurses over a run of white space; texts with a longer one go to ``tokenizers``.
SPACES = 20_000
_LONG_RUN = re.compile(rf"\s{{{SPACES}}}")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts, as the ``tokenizers`` library gives them for a byte-level BPE file.

    The file's own pieces and merge order are handed to ``tiktoken``, which applies them several times
    faster; probe texts must give the same ids in both libraries. Texts with very long runs of white space,
    which it can't take, are encoded by the library itself. Special tokens in a text are text, or
    with ``special`` one id each, as by the library's default; the library encodes the texts that have one.
    """

    PROBE = "The naïve  façade\n\n日本語 don't we'll 12345 #$%& <|endoftext|>\t end \U0001f600 "

    def __init__(self, path: str, special: bool = False):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        raw = byte_of()
        ranks = {bytes(map(raw.__getitem__, t)): k for t, k in model["vocab"].items() if all(c in raw for c in t)}
        added = {t.content.encode(): k for k, t in library.get_added_tokens_decoder().items()}
        ranks = {t: k for t, k in ranks.items() if added.get(t) != k}
        self.library, self.added = library, [t.decode() for t in added] if special else []
        self.ordinary = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for probe in (self.PROBE, self.PROBE.replace("<|endoftext|>", ""), *self.PROBE.split()):
            if self.encode(probe) != library.encode(probe, add_special_tokens=False).ids:
                raise ValueError(f"{path} is no byte-level BPE with the usual pattern")

    def encode(self, text: str) -> list[int]:
        if any(t in text for t in self.added) or (len(text) >= SPACES and _LONG_RUN.search(text)):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.ordinary(text)

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.encode(text), "<u4")


@lru_cache(maxsize=1)
def encoder(path: str, special: bool = False) -> Encoder:
    return Encoder(path, special)


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, special: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and a separator, cut only if longer than ``length``.

    Of a longer document the first piece takes the remainder, all others are full sequences.
    """

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, special)
        for batch in batches:
            texts, owner = strings(batch.column("text")), batch.column("doc_id").to_pylist()
            for part in chunks([len(t) for t in texts], 8 << 20):
                rows = []
                for doc, text in zip(owner[part], texts[part], strict=True):
                    ids = np.append(encode(text), np.uint32(SEPARATOR)).astype("<u4")
                    edge = [0, *range(len(ids) % length or length, len(ids) + 1, length)]
                    rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))]
                cols = [*zip(*rows, strict=True)]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids_crc32")
                yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(names, cols, kinds, strict=True)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Stock:
    """Unpacked lengths (1 to ``limit``) with their numbers; finds the longest that fits."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.tolist()
        self.present = [int(x) for x in np.flatnonzero(counts)]

    def fit(self, most: int) -> int:
        """The longest unpacked length up to ``most``, 0 if there is none."""
        k = bisect_right(self.present, most)
        return self.present[k - 1] if k else 0

    def take(self, length: int) -> None:
        self.n[length] -= 1
        if not self.n[length]:
            del self.present[bisect_right(self.present, length) - 1]

    def put(self, length: int) -> None:
        if not self.n[length]:
            self.present.insert(bisect_right(self.present, length), length)
        self.n[length] += 1

    def two(self, most: int, least: int) -> tuple[int, int]:
        """Two unpacked lengths with the largest sum up to ``most`` and over ``least``; (0, 0) if there are none."""
        best, pair = least, (0, 0)
        if 2 * self.present[0] > most:
            return pair
        i, j = 0, bisect_right(self.present, most - 1) - 1
        while i <= j and best < most:
            a, b = self.present[i], self.present[j]
            if a + b > most:
                j -= 1
                continue
            if a + b > best and (i != j or self.n[a] > 1):
                best, pair = a + b, (a, b)
            i += 1
        return pair


def best_two_fit(lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Bins of lengths that together are all of ``lengths``, each bin's sum at most ``limit``."""
    stock = _Stock(np.bincount(lengths, minlength=limit + 1))
    bins = []
    while stock.present:
        own, gap = [], limit
        while gap and (x := stock.fit(gap)):
            stock.take(x)
            own.append(x)
            gap -= x
        if gap and stock.present and len(own) > 1:
            small = own[-1]  # filled in descending order: the last one is the smallest
            a, b = stock.two(gap + small, small)
            if a:
                stock.take(a)
                stock.take(b)
                stock.put(small)
                own[-1:] = [b, a]
        bins.append(own)
    return bins


def _pack(length: int):
    def of(own: pa.Table) -> pa.Table:
        own = own.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins = best_two_fit(own.column("length").to_numpy(), length)
        flat = np.array([x for b in bins for x in b], np.int64)
        seq = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        at = np.concatenate([np.cumsum([0, *b[:-1]]) for b in bins]).astype(np.int64)
        order = np.argsort(-flat, kind="stable")  # pieces of one length are alike: any takes any place
        first = own.column("part")[0].as_py() << 32
        return own.drop_columns(["part"]).append_column("sequence_id", pa.array(first + seq[order])).append_column("offset", pa.array(at[order]))

    return of


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, special: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most ``length`` tokens as best-two-fit needs.

    Returns, for each piece, doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and
    empty texts are one separator; repeated rows and rows of null doc_id are packed like any others
    (a null doc_id stays null); full pieces are their own sequence. With ``special``, a special token's
    name in a text is that token, as by the library's default; without, it is text. Columns other than
    doc_id and text are not looked at. An empty table gives an empty table.
    """
    found = pieces(docs, tokenizer, length, special)
    n, n_bytes = text_size(docs)
    groups = max(1, -(-(n + n_bytes // length) // GROUP))  # a text has no more tokens than bytes
    dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(groups)))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("part").applyInArrow(_pack(length), kind)
