"""SentencePiece encoding and decoding by a batched NumPy Viterbi search.

A text is cut where a run of word-start marks begins; no piece of a model crosses such a place, so
words are segmented by themselves, and each distinct one once. A new word is cut again between any
two characters that are side by side in no piece: neither a piece nor a merge reaches across, so the
parts (a word, its full stop, a line break, the next word) have the ids they have alone, and far
fewer of them are distinct. Parts of equal length (long ones: of similar length, filled up at the end,
which no prefix sees) advance together: hashes of all their substrings probe the table of piece keys,
and at each place one vectorised maximum over the lengths of the last piece stores the back pointers.
Characters without a piece are spelled in byte pieces.

What the maximum is taken of depends on the model. Unigram: the sum of scores; ties go to the
longer last piece. Merges (BPE): whether the last piece may follow the one before it. A sequence of
pieces is the result of merging if and only if each piece and each two neighbours are the result of
merging their own characters, so exactly one last piece of every prefix qualifies. Whether two pieces
stay side by side is worked out for arrays of pairs: both are taken apart, the later merge first,
and at no time may the parts that meet merge before the part that holds them was made. Sums of scores
would give other ids than the library.

A very long word is cut into overlapping windows that advance together like words of one length. A
window is right from where its last pieces agree with the window before it over as many places as the
longest piece has characters, as all that follows depends on these only; a window that does not come
to agree is searched again from the state of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import chunks, mix, strings

MARK = "▁"
#: What the library takes off the lowest score for a character without a piece.
UNKNOWN_PENALTY = 10.0
#: Distinct parts that are remembered: those of the present batch and of batches before it, by turns.
WORDS_KEPT = 150_000
#: Places (words by length) that one search holds.
CELLS = 1 << 16
#: Words over this length are cut into windows, which overlap by so many characters.
WINDOW, OVERLAP = 2048, 128
#: Characters of new words that are cut into parts at a time; a very long word has a cut in so many characters at most.
BLOCK, CELL = 1 << 18, 256
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
#: Ids from here on are lone characters without a piece.
_LONE = 1 << 24
_K = np.uint64(0x9E3779B97F4A7C15)


def _substrings(codes: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, rolling hash of each row's substrings of that length at every start)."""
    acc = np.zeros(codes.shape, np.uint64)
    for n in range(1, min(most, codes.shape[1]) + 1):
        acc = acc[:, : codes.shape[1] - n + 1] * _K + codes[:, n - 1 :] + np.uint64(1)
        yield n, acc


def _place(hashes: np.ndarray) -> np.ndarray:
    """20 bits of a hash: where a table of what may be there is asked first."""
    return hashes * _K >> np.uint64(44)


def _table(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[_place(hashes)] = True
    return out


class _Index:
    """Distinct keys in the order of ``keys * _K``, found by where the keys of a place begin; a few by bisection."""

    def __init__(self, keys: np.ndarray):
        count = np.bincount(_place(keys).astype(np.int64), minlength=1 << 20)
        self.order, self.begin, self.most = keys * _K, (np.cumsum(count) - count).astype(np.int32), int(count.max())

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each key would be, whether it is there)."""
        asked, end = asked * _K, len(self.order) - 1
        few = len(asked) < 500
        k = np.minimum(np.searchsorted(self.order, asked) if few else self.begin[asked >> np.uint64(44)], end)
        hit = self.order[k] == asked
        for _ in range(1, 1 if few else self.most):
            rest = np.flatnonzero(~hit)
            k[rest] = np.minimum(k[rest] + 1, end)
            hit[rest] = self.order[k[rest]] == asked[rest]
        return k, hit


class Codec:
    """A SentencePiece model (identity normalisation, dummy prefix, byte fallback) and the words seen so far."""

    def __init__(self, path: str, model: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        if model is None:
            with open(path, "rb") as f:
                model = f.read()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
            raise ValueError("only models of identity normalisation with a dummy prefix and byte fallback are read")
        pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        plain = [(k, p, s) for k, (p, s, t) in enumerate(pieces) if t in (_NORMAL, _USER)]
        if any(MARK in p.lstrip(MARK) for _, p, _ in plain):
            raise ValueError("a piece crosses a word's start")
        self.longest = max(len(p) for _, p, _ in plain)
        rolled = np.empty(len(plain), np.uint64)
        sizes = np.array([len(p) for _, p, _ in plain], np.uint64)
        for n in range(1, self.longest + 1):
            at = [k for k, (_, p, _) in enumerate(plain) if len(p) == n]
            if at:
                codes = np.array([[ord(c) for c in plain[k][1]] for k in at], np.uint64)
                rolled[at] = [*_substrings(codes, n)][-1][1][:, 0]
        keys = mix(rolled + sizes)
        self.probe = _table(rolled)
        self.beside = _table(np.array([ord(a) << 21 | ord(b) for a, b in {x for _, p, _ in plain for x in pairwise(p)}], np.uint64))
        order = np.argsort(keys * _K)
        self.keys = keys[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        self.ids = np.array([k for k, _, _ in plain], np.int32)[order]
        self.scores = np.array([s for _, _, s in plain])[order]
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY
        self.merges = proto.trainer_spec.model_type == pb.TrainerSpec.BPE
        if self.merges:
            self._learn_merges({p: k for k, p, _ in plain}, {p: s for _, p, s in plain}, len(pieces))
        self.index = _Index(self.keys)
        self.byte = np.array([k for k, (_, _, t) in enumerate(pieces) if t == _BYTE], np.int32)
        self.surface = [b"" if t == _CONTROL else b" \xe2\x81\x87 " if t == _UNKNOWN else bytes([int(p[1:-1], 16)]) if t == _BYTE else p.replace(MARK, " ").encode() for p, _, t in pieces]
        self.surfaces = pa.array(self.surface, pa.binary())
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def _learn_merges(self, ids: dict[str, int], score: dict[str, float], n: int) -> None:
        """Which two parts make a piece and when, and the parts that each piece is made of when its characters alone are merged."""
        lone = sorted({c for p in ids for c in p}.difference(ids))  # characters that are in pieces only: numbers after all ids
        ids = ids | {c: n + 1 + k for k, c in enumerate(lone)}
        self.nowhere, self.lone = n, np.array([ord(c) for c in lone], np.int64)
        order = {s: k for k, s in enumerate(sorted({score[p] for p in score if len(p) > 1}, reverse=True))}
        self.rank = np.full(n + 1 + len(lone), -1, np.int64)  # when a piece is made; -1: a character
        self.left = self.right = np.zeros(0, np.int64)
        left, right = np.zeros_like(self.rank), np.zeros_like(self.rank)
        made: list[tuple[int, int, int]] = []
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for p in score:
            if len(p) > 1:
                self.rank[ids[p]] = order[score[p]]
                parts = [(ids[p], ids[p[:k]], ids[p[k:]]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
                made += parts
                by_length.setdefault(len(p), []).extend(parts)
        whole, one, two = np.array(made, np.int64).reshape(-1, 3).T
        pair = (one << 32 | two).view(np.uint64)
        order_ = np.argsort(pair * _K)
        self.pair, self.pair_rank = _Index(pair[order_]), self.rank[whole][order_]
        self.pair_probe = _table(pair)
        self.left, self.right = left, right
        reached = self.rank < 0
        for _, parts in sorted(by_length.items()):
            whole, one, two = np.array(parts, np.int64).reshape(-1, 3).T
            good = reached[one] & reached[two]
            whole, one, two = whole[good], one[good], two[good]
            good = self._apart(one, two, made=True)
            left[whole[good]], right[whole[good]] = one[good], two[good]
            reached[whole[good]] = True
        keep = reached[self.ids]  # no merging of its own characters gives the others
        self.keys, self.ids, self.scores = self.keys[keep], self.ids[keep], self.scores[keep]

    def _number(self, piece: np.ndarray) -> np.ndarray:
        """Pieces as numbers of the merge tables; a character that is in no piece is ``nowhere``."""
        out = np.where(piece < _LONE, piece, self.nowhere)
        if len(self.lone):
            k = np.minimum(np.searchsorted(self.lone, piece - _LONE), len(self.lone) - 1)
            out = np.where(self.lone[k] == piece - _LONE, self.nowhere + 1 + k, out)
        return out

    def _apart(self, one: np.ndarray, two: np.ndarray, made: bool = False) -> np.ndarray:
        """Whether two pieces stay side by side when their characters are merged (``made``: but for their own merge)."""
        out = np.ones(len(one), bool)
        at, a, b, limit = np.arange(len(one)), one, two, np.full(len(one), np.iinfo(np.int64).max)
        while len(at):
            if not made:
                pair, bad = (a << 32 | b).view(np.uint64), np.zeros(len(at), bool)
                asked = np.flatnonzero(self.pair_probe[_place(pair)])
                if len(asked):
                    k, hit = self.pair.find(pair[asked])
                    bad[asked] = hit & (self.pair_rank[k] < limit[asked])
                out[at[bad]] = False
            else:
                bad, made = np.zeros(len(at), bool), False
            when_a, when_b = self.rank[a], self.rank[b]
            more = ~bad & ((when_a >= 0) | (when_b >= 0))
            at, a, b, when_a, when_b = (x[more] for x in (at, a, b, when_a, when_b))
            first = when_a > when_b
            limit = np.where(first, when_a, when_b + 1)  # of equal merges the left one is first
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def _search(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of about one length."""
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        text = "".join(words if sizes.min() == width else [w.ljust(width, "\0") for w in words])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(len(words), -1)
        return self._ids(sizes, *self._advance(codes))

    def _advance(self, codes: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The last piece of each row's prefixes, and its length. ``start``: the last pieces (-1: none) that are known already."""
        m, length = codes.shape
        found = []
        for n, h in _substrings(codes, self.longest):
            r, at = np.nonzero(self.probe[_place(h)])
            k, hit = self.index.find(mix(h[r, at] + np.uint64(n)))
            found.append((at[hit] + n, r[hit], np.full(int(hit.sum()), n), self.ids[k[hit]].astype(np.int64), self.scores[k[hit]]))
            if n == 1:
                alone = np.ones((m, length), bool)
                alone[r[hit], at[hit]] = False
                r, at = np.nonzero(alone)
                found.append((at + 1, r, np.ones(len(r), np.int64), codes[r, at].astype(np.int64) + _LONE, np.full(len(r), self.unknown)))
        end, row, size, piece, score = (np.concatenate(x) for x in zip(*found, strict=True))
        if length < 1 << 16:
            end = end.astype(np.uint16)  # sorted by digits
        order = np.argsort(end, kind="stable")
        row, size, piece, score = row[order], size[order], piece[order], score[order]
        cut = np.searchsorted(end[order], np.arange(1, length + 2)).tolist()
        last, back = np.full((length + 1, m), -1, np.int64), np.zeros((length + 1, m), np.int32)
        best = None if self.merges else np.zeros((length + 1, m))
        number = self._number(piece) if self.merges else piece
        state = np.full((length + 1, m), -1, np.int64)
        every = np.arange(m)
        for e in range(1, length + 1):
            a, b = cut[e - 1], cut[e]
            r, n, p, q = row[a:b], size[a:b], piece[a:b], number[a:b]
            if self.merges:
                before = state[e - n, r]
                fits = e == n
                ask = np.flatnonzero(before >= 0)
                fits[ask] = self._apart(before[ask], q[ask])
                won = np.flatnonzero(fits)  # one for each row
                back[e, r[won]] = n[won]
            else:
                value = np.full((m, self.longest + 1), -np.inf)
                value[r, self.longest - n] = best[e - n, r] + score[a:b]
                top = value.argmax(1)  # of equals the longest
                best[e], back[e] = value[every, top], self.longest - top
                won = np.flatnonzero(back[e, r] == n)
            last[e, r[won]], state[e, r[won]] = p[won], q[won]
            if start is not None and e < start.shape[0]:
                known = start[e] >= 0
                last[e, known], state[e, known] = start[e, known], self._number(start[e, known])
        return last, back

    def _ids(self, sizes: np.ndarray, last: np.ndarray, back: np.ndarray) -> list[np.ndarray]:
        """Ids of the rows' prefixes of these sizes, by the back pointers of all rows at once."""
        m, length = len(sizes), int(sizes.max())
        out, at, rows = np.zeros((m, length), np.int64), sizes.copy(), np.arange(m)
        width = np.zeros(m, np.int64)
        while len(rows):
            end = at[rows]
            width[rows] += 1
            out[rows, length - width[rows]] = last[end, rows]
            at[rows] = end - back[end, rows]
            rows = rows[at[rows] > 0]
        alone = (out >= _LONE).any(1)
        out = out.astype("<i4")
        return [self._spelled(x[length - n :]) if lone else x[length - n :] for x, n, lone in zip(out, width.tolist(), alone.tolist(), strict=True)]

    def _spelled(self, pieces: np.ndarray) -> np.ndarray:
        """Ids, with characters without a piece in byte pieces."""
        parts: list[int] = []
        for p in pieces.tolist():
            parts += [p] if p < _LONE else self.byte[np.frombuffer(chr(p - _LONE).encode("utf-8", "surrogatepass"), np.uint8)].tolist()
        return np.array(parts, "<i4")

    def _search_long(self, word: str) -> np.ndarray:
        """Ids of a very long word of a model of merges, window by window."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        parts, carry, done = [], None, 0  # carry: the last pieces of the places up to ``done``
        lasts, backs = [], []
        again: dict[bytes, tuple] = {}  # periodic text asks the same of window after window
        step = WINDOW - OVERLAP
        begins = [*range(0, max(1, len(codes) - OVERLAP), step)]
        group = max(1, CELLS // WINDOW)
        for g in range(0, len(begins), group):
            own = begins[g : g + group]
            full = [b for b in own if b + WINDOW <= len(codes)]
            runs = [(full, WINDOW)] if full else []
            runs += [([b], len(codes) - b) for b in own if b + WINDOW > len(codes)]
            for starts, width in runs:
                block = np.stack([codes[b : b + width] for b in starts])
                last, back = self._advance(block)
                for k, b in enumerate(starts):
                    one, two = last[:, k], back[:, k]
                    if b:
                        seen = carry[-(done - b) - 1 :]  # states at places b to done
                        same = one[: len(seen)] == seen
                        run = np.convolve(same[1:], np.ones(self.longest, np.int64), "valid") == self.longest
                        if not run.any():  # not yet alike: once more, from the state of the window before
                            lead = np.concatenate(([-1], seen[1:]))[:, None]
                            key = block[k].tobytes() + lead.tobytes()
                            if key not in again:
                                if len(again) > 2 * self.longest:
                                    again.clear()
                                x, y = self._advance(block[k : k + 1], lead)
                                again[key] = x[:, 0], y[:, 0]
                            one, two = again[key]
                        one, two = one[len(seen) :], two[len(seen) :]
                    else:
                        one, two = one[1:], two[1:]
                    lasts.append(one.astype(np.int32))
                    backs.append(two.astype(np.int8 if self.longest < 128 else np.int32))
                    done = b + width
                    carry = np.concatenate(([-1], *lasts[-2:])) if len(lasts) > 1 else np.concatenate(([-1], one))
        last, back = np.concatenate(lasts), np.concatenate(backs)
        at = len(codes)
        while at:
            parts.append(int(last[at - 1]))
            at -= int(back[at - 1])
        return self._spelled(np.array(parts[::-1], np.int64))

    def _begins(self, text: str, sizes: list[int]) -> np.ndarray:
        """Where the parts of words begin that are joined in ``text``, and its end."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        cut = np.concatenate(([False], ~self.beside[_place(codes[:-1] << np.uint64(21) | codes[1:])], [True]))
        ends = np.cumsum(sizes)
        for k in np.flatnonzero(np.array(sizes) > WINDOW):  # a bounded number of parts
            own = cut[ends[k] - sizes[k] : ends[k]]
            at = np.flatnonzero(own)
            own[at[1:][at[1:] // CELL == at[:-1] // CELL]] = False
            if np.diff(np.flatnonzero(own), prepend=0, append=len(own)).max() > WINDOW:
                own[:] = False  # windows of one long word advance together
        cut[ends - sizes] = True
        return np.flatnonzero(cut).astype(np.int32)

    def _missing(self, words: set[str]) -> set[str]:
        """Words that have to be searched; those of batches before are known again."""
        words = words.difference(self.known)
        again = words.intersection(self.older)
        self.known.update((w, self.older[w]) for w in again)
        return words - again

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of distinct words. Only parts are remembered: a word of several is soon put together again."""
        new, parts, blocks = list(self._missing(words)), set(), []
        sizes = [len(w) for w in new]
        for own in chunks(sizes, BLOCK):
            text = "".join(new[own])
            begins = self._begins(text, sizes[own])
            parts.update(text[a:b] for a, b in pairwise(begins.tolist()))
            blocks.append((own, text, begins))
        self._learn_parts(self._missing(parts))
        ids, known = {}, self.known
        for own, text, begins in blocks:
            first = np.searchsorted(begins, np.concatenate(([0], np.cumsum(sizes[own]))))
            several, at = np.flatnonzero(np.diff(first) > 1).tolist(), begins.tolist()
            first = first.tolist()
            for k in several:
                ids[new[own.start + k]] = b"".join([known[text[a:b]] for a, b in pairwise(at[first[k] : first[k + 1] + 1])])
        ids.update((w, known[w]) for w in words.difference(ids))
        return ids

    def _learn_parts(self, parts: Iterable[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in parts:
            if len(w) > WINDOW and self.merges:
                self.known[w] = self._search_long(w).tobytes()
            else:
                unit = 1 << max(0, len(w).bit_length() - 4) if len(w) > 64 else 1
                by_length.setdefault(-(-len(w) // unit) * unit, []).append(w)
        for length, group in by_length.items():
            step = max(1, CELLS // length)
            for a in range(0, len(group), step):
                part = group[a : a + step]
                for w, ids in zip(part, self._search(part), strict=True):
                    self.known[w] = ids.tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; an empty text has none."""
        words = [self.cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > WORDS_KEPT:
            self.known, self.older = {}, self.known
        ids = self.learn(set(chain.from_iterable(words)))
        return [np.frombuffer(b"".join(map(ids.__getitem__, own)), "<i4") for own in words]

    def decode(self, ids) -> str:
        """The text of ids: byte pieces in a row are UTF-8 (what isn't becomes U+FFFD), the dummy prefix goes."""
        raw = b"".join(map(self.surface.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")

    def decode_rows(self, lists: pa.ListArray) -> Iterator[str]:
        """``decode`` of every row's ids, about a million pieces at a time; null ids have no text."""
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        ids, ends = lists.flatten(), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        for part in chunks(sizes.tolist(), 1 << 20):
            begin, end = ends[part.start], ends[part.stop]
            taken = self.surfaces.take(ids.slice(begin, end - begin))
            _, offsets, data = taken.buffers()
            at = np.frombuffer(offsets, np.int32)[taken.offset :][ends[part.start : part.stop + 1] - begin].tolist() if end > begin else [0] * (part.stop - part.start + 1)
            for a, b in pairwise(at):
                yield data[a:b].to_pybytes().removeprefix(b" ").decode("utf-8", "replace") if b > a else ""


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids of every whole text.

    Null and empty texts have no ids. ``model`` is a file that driver and executors have at one path.
    Columns other than doc_id and text are not looked at; an empty table gives an empty table.
    """

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = strings(batch.column("text"))
            for part in chunks([len(t) for t in texts], 2 << 20):
                found = own.encode(texts[part])
                ends = np.concatenate(([0], np.cumsum([len(x) for x in found])))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, "<i4"), *found]).astype(np.int32)))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(part.start, part.stop - part.start), "n_ids": pa.array(np.diff(ends)), "ids": ids})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, n_ids long, ids array<int>")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """doc_id, text of every row's ids; null ids are a null text."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            lists = batch.column("ids")
            text = [t if valid else None for t, valid in zip(own.decode_rows(lists), lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(text, pa.string())})

    return rows.select("doc_id", "ids").mapInArrow(of, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids, decoded_sha256 of every whole text: encoded, and decoded again from its ids."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        own = codec(model)
        for batch in batches:
            digest = [hashlib.sha256(t.encode()).hexdigest() for t in own.decode_rows(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digest, pa.string())], ["doc_id", "n_ids", "ids", "decoded_sha256"])

    return encode(docs, model).mapInArrow(of, "doc_id long, n_ids long, ids array<int>, decoded_sha256 string")
