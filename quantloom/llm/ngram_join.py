"""N-gram Jaccard self-join by a size-aware heavy-light scheme.

A document is the set of its distinct 5-word shingles. Two sets with similarity ``num/den`` or more
share a token among the first ``n - ceil(n*num/den) + 1`` of any common token order (the prefix),
and ``c`` tokens among the first ``n - ceil(n*num/den) + c``.

The prefixes are a little longer than that: two larger sets must share ``COMMON`` tokens of them before
they are looked at, which chance hardly gives.

* Small (light) sets enumerate all 2-subsets of their longer prefix and meet in buckets of equal subsets.
* Large (heavy) sets, and the small ones that can still reach them, scan inverted lists of prefix tokens.
* The boundary is the size at which enumerating costs more than scanning, from the corpus's mean list length.

The common order puts frequent tokens last. Their counts come from a pass over every shingle of the
corpus; how many of the most frequent ones are kept is bounded (``HOT_TOKENS``), which only affects
speed. Within a list of many sets, each set is first held against the smallest one. What those
links don't join (or what shares too few tokens in shorter lists, but some long one) is held against the rest by bitmaps, which bound the overlap from above, in cells
of bounded size: all pairs that are left between components or, where these are many, first as few
as could join the sets and then what is still left. So a group of near copies costs a link for each member and not one for each pair, and no
link that would join two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import by_range, chunks, discard, frame, join_packed, materialize, mix, pack, small_batches, squeeze, strings, text_size, unsqueeze, words_of
from quantloom.llm.components import components

WORDS = 5
#: At most so many frequent tokens are broadcast: 12 bytes each.
HOT_TOKENS = 1 << 18
#: Bits of a set's bitmap at most.
BITMAP_MOST = 1 << 16
#: Lists of up to so many sets are expanded into all their pairs at once.
SMALL_LIST = 8
#: Tokens of their prefixes that two larger sets must have in common to be looked at (or all that a link needs).
COMMON = 3
#: A longer list is dealt to blocks of about so many sets.
BLOCK = 500
#: Pairs of one text side that one task verifies before the side is dealt to several.
HOT_SIDE = 2_000
#: Text whose tokens one task counts or lists at once, and tokens that a mapper holds before it sends them.
RANGE_BYTES, FLUSH = 8 << 20, 1_000_000
_PLACE = np.random.default_rng(11).integers(0, 1 << 64, WORDS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a shorter text is one shingle, no words give none."""
    out: list[np.ndarray] = []
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    place = _PLACE[:words]
    for part in chunks([len(t) for t in raw]):
        word, owner = words_of(raw[part])
        count = part.stop - part.start
        first = np.searchsorted(owner, np.arange(count + 1))
        if len(word) >= words:
            acc = word[: len(word) - words + 1] * place[0]
            for k in range(1, words):
                acc = acc + word[k : len(word) - words + 1 + k] * place[k]
            acc = mix(acc)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                s = np.sort(acc[a : b - words + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
            elif b > a:
                out.append(mix((word[a:b] * place[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def _ceil(n, num: int, den: int):
    return -((-n * num) // den)


class _Rule:
    """Similarity num/den and what follows from it; picklable."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n, c: int = 1):
        """Tokens to look at so that partners of any size share ``c`` of them."""
        return np.minimum(n, n - _ceil(n, self.num, self.den) + c)

    def index(self, n, c: int = 1):
        """The same for partners that are no smaller."""
        return np.minimum(n, n - _ceil(n, 2 * self.num, self.num + self.den) + c)

    def need(self, a, b, c: int):
        """Tokens that links between sets of these sizes have in common in their prefixes for ``c``."""
        return np.minimum(c, _ceil(a + b, self.num, self.num + self.den))

    def sizes(self, a, b):
        return np.minimum(a, b) * self.den >= np.maximum(a, b) * self.num

    def links(self, x: np.ndarray, y: np.ndarray) -> bool:
        both = np.concatenate((x, y))
        both.sort()
        same = int((both[1:] == both[:-1]).sum())
        return same * self.den >= (len(both) - same) * self.num


def _frequent(docs: DataFrame, n_bytes: int) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Fingerprints and counts of frequent shingles, the fingerprint's width, the mean co-members of a token."""
    bits = min(56, max(32, int(n_bytes).bit_length() + 3))
    ranges = max(12, n_bytes // RANGE_BYTES)

    def fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            fp, n = np.unique(np.concatenate(held) >> np.uint64(64 - bits), return_counts=True)
            rows = [(r, pack(fp[a:b], n[a:b].astype(np.uint32))) for r, a, b in by_range(fp, ranges, bits)]
            return pa.RecordBatch.from_pydict({"r": pa.array([r for r, _ in rows], pa.int32()), "blob": pa.array([x for _, x in rows], pa.binary())})

        held: list[np.ndarray] = []
        total = 0
        for batch in batches:
            texts = strings(batch.column("text"))
            for part in chunks([len(t) for t in texts], 4 << 20):
                held += shingle_sets(texts[part])
                total += sum(map(len, held[-(part.stop - part.start) :]))
                if total >= FLUSH:
                    yield flush(held)
                    held, total = [], 0
        if total:
            yield flush(held)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, n = join_packed(pdf["blob"])
        order = np.argsort(fp, kind="stable")
        fp, n = fp[order], n[order].astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1])))
        fp, n = fp[at], np.add.reduceat(n, at)
        top = np.flatnonzero(n >= 4)
        top = top[np.argsort(-n[top], kind="stable")[:HOT_TOKENS]]
        cold = np.delete(n, top).astype(float)
        return frame({"fp": np.append(fp[top].astype(np.int64), [-1, -2]), "n": np.append(n[top].astype(float), [cold.sum(), (cold * cold).sum()])}, ["fp", "n"])

    counted = materialize(docs.select("text").mapInArrow(fingerprints, "r int, blob binary").groupBy("r").applyInPandas(count, "fp long, n double"), "counts")
    got = counted.where("fp >= 0").orderBy(F.desc("n"), "fp").limit(HOT_TOKENS).toArrow().sort_by("fp")
    stat = {r["fp"]: r["n"] for r in counted.where("fp < 0").groupBy("fp").agg(F.sum("n").alias("n")).collect()}
    discard(counted)
    others = max(0.0, stat.get(-2, 0.0) / max(1.0, stat.get(-1, 0.0)) - 1)
    return got["fp"].to_numpy().astype(np.uint64), got["n"].to_numpy().astype(np.uint32), bits, others


def _lookup(hot: np.ndarray, counts: np.ndarray, bits: int, tokens: np.ndarray) -> np.ndarray:
    """Counts of frequent tokens, 0 for all others."""
    if not len(hot):
        return np.zeros(len(tokens), np.uint32)
    fp = tokens >> np.uint64(64 - bits)
    at = np.minimum(np.searchsorted(hot, fp), len(hot) - 1)
    return np.where(hot[at] == fp, counts[at], np.uint32(0))


def bitmap(s: np.ndarray) -> bytes:
    """Which low bits a set's tokens have, in some 4 to 8 bits for each token: two sets differ in a token for each bit of only one."""
    size = min(BITMAP_MOST, max(64, 1 << (4 * len(s) - 1).bit_length()))
    bits = np.zeros(size, bool)
    bits[s & np.uint64(size - 1)] = True
    return np.packbits(bits).tobytes()


def most_common(n: int, bits: np.ndarray, others_n: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Upper bounds of the tokens that a set shares with others, from bitmaps of one width."""
    ones = lambda x: np.bitwise_count(x.view(np.uint64)).sum(-1, dtype=np.int64)
    return np.minimum(n - ones(bits & ~others), others_n - ones(others & ~bits))


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap (bytes) at a smaller width."""
    return np.bitwise_or.reduce(bits.reshape(-1, width), axis=0)


def _prefixes(docs: DataFrame, rule: _Rule, hot) -> DataFrame:
    """doc_id, n, digest of the set, its first tokens in the common order, and its bitmap."""
    import hashlib

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, counts, bits = hot.value
        for batch in batches:
            texts, ids = strings(batch.column("text")), batch.column("doc_id").to_pylist()
            for part in chunks([len(t) for t in texts], 4 << 20):
                size, digest, blob, bits_ = [], [], [], []
                for s in shingle_sets(texts[part]):
                    size.append(len(s))
                    bits_.append(bitmap(s) if len(s) else None)
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    if len(s):
                        freq = _lookup(fps, counts, bits, s)
                        first = s[np.argsort(freq, kind="stable")] if freq.any() else s
                        blob.append(first[: rule.prefix(len(s), max(2, COMMON))].tobytes())
                    else:
                        blob.append(None)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[part], pa.int64()), "n": pa.array(size, pa.int64()), "digest": pa.array(digest, pa.binary()), "blob": pa.array(blob, pa.binary()), "bits": pa.array(bits_, pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, n long, digest binary, blob binary, bits binary")


def _boundary(rule: _Rule, others: float) -> int:
    """The largest size up to which enumerating 2-subsets costs no more than scanning lists, for every size below."""
    limit = 4
    while limit < 512:
        n = limit + 1
        p1, p2 = int(rule.prefix(n)), int(rule.prefix(n, 2))
        if p2 * (p2 - 1) / 2 > p1 * (1 + others):
            break
        limit = n
    return limit


def _postings(sets: DataFrame, rule: _Rule, light: int, hot, ranges: int) -> DataFrame:
    """Packed inverted lists by token range: token, set, and size * 4 + index flag * 2 + heavy flag."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, counts, bits = hot.value

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            token, rep, info = (np.concatenate(x) for x in zip(*rows, strict=True))
            freq = _lookup(fps, counts, bits, token)
            parts = np.maximum(1, -(-freq.astype(np.int64) // BLOCK)).astype(np.uint64)
            r = (token >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            r = (r + mix(rep.astype(np.uint64)) % parts) % np.uint64(ranges)
            order = np.lexsort((token, r))
            r, token, rep, info = r[order], token[order], rep[order], info[order]
            cut = [*np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))).tolist(), len(r)]
            return pa.RecordBatch.from_pydict({"r": pa.array(r[cut[:-1]].astype(np.int32)), "blob": pa.array([pack(token[a:b], rep[a:b], info[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

        rows: list[tuple] = []
        total = 0
        for batch in batches:
            for rep, n, blob in zip(batch.column("rep").to_pylist(), batch.column("n").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                tokens = np.frombuffer(blob, np.uint64)
                if n > light or n * rule.den >= (light + 1) * rule.num:
                    p, i = int(rule.prefix(n, COMMON)), int(rule.index(n, COMMON))
                    info = np.full(p, n * 4 + (n > light), np.int64)
                    info[:i] += 2
                    rows.append((tokens[:p], np.full(p, rep, np.int64), info))
                if n <= light:
                    p = int(rule.prefix(n, 2))
                    a, b = np.triu_indices(p, 1)
                    low, high = np.minimum(tokens[a], tokens[b]), np.maximum(tokens[a], tokens[b])
                    rows.append((mix(low * _PLACE[0] + high * _PLACE[1]), np.full(len(a), rep, np.int64), np.full(len(a), n * 4 + 3, np.int64)))
                total += len(rows[-1][0])
                if total >= FLUSH // 2:
                    yield flush(rows)
                    rows, total = [], 0
        if total:
            yield flush(rows)

    return sets.mapInArrow(of, "r int, blob binary")


def _may(rule: _Rule, a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Whether two postings of a list can belong to a link: sizes, one heavy, the smaller within its index prefix."""
    na, nb = ia >> 2, ib >> 2
    less = (na < nb) | ((na == nb) & (a < b))
    index = np.where(less, ia & 2, ib & 2) + np.where(na == nb, np.where(less, ib & 2, ia & 2), 0) > 0
    return rule.sizes(na, nb) & ((ia | ib) & 1 > 0) & index & (a != b)


def _candidates(rule: _Rule, hot, light: int):
    """Pairs (token 0, x, y, how often, how often is enough) of a range's lists, and the members of long lists (y: info, 0, 0)."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, counts, bits = hot.value
        token, rep, info = join_packed(pdf["blob"])
        order = np.lexsort((rep, token))
        token, rep, info = token[order], rep[order], info[order]
        at = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        size = np.diff(np.append(at, len(token)))
        split = _lookup(fps, counts, bits, token[at]) > BLOCK
        found = [np.empty((4, 0), np.int64)]

        def pairs(a: np.ndarray, b: np.ndarray) -> None:
            found.append(np.stack((rep[a], rep[b], info[a] >> 2, info[b] >> 2)))

        for m in range(2, SMALL_LIST + 1):
            begin = at[(size == m) & ~split]
            for i in range(m):
                for j in range(i + 1, m):
                    a, b = begin + i, begin + j
                    ok = _may(rule, rep[a], info[a], rep[b], info[b])
                    pairs(a[ok], b[ok])
        large = np.flatnonzero(np.repeat((size > SMALL_LIST) | split, size))
        center = np.repeat(at, size)[large]
        ok = rule.sizes(info[center] >> 2, info[large] >> 2) & (rep[center] != rep[large])
        pairs(center[ok], large[ok])
        x, y, n, m = np.concatenate(found, axis=1)
        x, y = np.minimum(x, y), np.maximum(x, y)
        enough = np.where(np.minimum(n, m) <= light, 1, rule.need(n, m, COMMON))
        order = np.lexsort((y, x))
        x, y, enough = x[order], y[order], enough[order]
        first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(x) else np.empty(0, np.int64)
        often = np.diff(np.append(first, len(x)))
        # of a long list, the members that another one is near enough in size
        large = large[np.lexsort((info[large] >> 2, token[large]))]
        near = (token[large][1:] == token[large][:-1]) & rule.sizes(info[large][1:] >> 2, info[large][:-1] >> 2) if len(large) else np.empty(0, bool)
        keep = np.concatenate(([False], near)) | np.concatenate((near, [False])) if len(large) else near
        large = large[keep | np.repeat(split, size)[large]]
        none = np.zeros(len(large), np.int64)
        return frame(
            {
                "token": np.append(np.zeros(len(first), np.int64), token[large].view(np.int64)), "x": np.append(x[first], rep[large]), "y": np.append(y[first], info[large]),
                "often": np.append(often, none), "enough": np.append(enough[first], none), "list": np.append(np.zeros(len(first), bool), np.ones(len(large), bool)),
            },
            ["token", "x", "y", "often", "enough", "list"],
        )

    return of


def _remaining(rule: _Rule, whole: bool):
    """Pairs of a cell's outsiders (in a group's smaller components) and members that no link has joined so far and whose bitmaps allow one.

    A cell whose pairs are many gives only as many as would join its sets if all are links, and a row
    of its center and null; ``whole``: it gives all of them.
    """

    def of(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(tables))
        rep, info, comp, out = (t.column(c).to_numpy() for c in ("x", "info", "component", "outsider"))
        raw = t.column("bits").to_pylist()
        _, comp = np.unique(comp, return_inverse=True)
        root = np.arange(comp.max() + 1)
        own, order = np.flatnonzero(out), np.flatnonzero(~out)
        order = order[np.lexsort((rep[order], info[order] >> 2))]
        size = info[order] >> 2
        width = np.array([len(raw[k]) for k in order.tolist()])  # ascends with the size
        least = np.searchsorted(size * rule.den, (info[own] >> 2) * rule.num)
        most = np.searchsorted(size * rule.num, (info[own] >> 2) * rule.den, "right")
        narrow: tuple[int, int, np.ndarray] = (0, 0, np.empty((0, 0), np.uint8))
        span = 4 * -(-(rule.den**2) // rule.num**2)  # partners' widths are within this factor
        limit = np.inf if whole else 1000 + 4 * len(rep)
        xs, ys, held, total = [], [], 0, 0
        for i, a, b in sorted(zip(own.tolist(), least.tolist(), most.tolist(), strict=True), key=lambda x: int(info[x[0]])):
            if a >= b:
                continue
            k = order[a:b]
            at = np.flatnonzero((root[comp[k]] != root[comp[i]]) & _may(rule, rep[k], info[k], rep[i], info[i])) + a
            if not len(at):
                continue
            w = min(int(width[at[0]]), len(raw[i]))  # all are brought to the narrowest
            first, last = int(np.searchsorted(width, w)), int(np.searchsorted(width, span * w, "right"))
            if narrow[0] != w:
                narrow = (w, first, np.stack([fold(np.frombuffer(raw[j], np.uint8), w) for j in order[first:last].tolist()]))
            bits = fold(np.frombuffer(raw[i], np.uint8), w)
            bound = most_common(int(info[i] >> 2), bits, size[at], narrow[2][at - first])
            at = order[at[bound * (rule.num + rule.den) >= rule.num * (size[at] + (info[i] >> 2))]]
            if total > limit and len(at):
                _, j = np.unique(root[comp[at]], return_index=True)
                at = at[j]
                joined = np.append(root[comp[at]], root[comp[i]])
                root[np.isin(root, joined)] = joined.min()
            if len(at):
                xs.append(np.minimum(rep[at], rep[i]))
                ys.append(np.maximum(rep[at], rep[i]))
                held, total = held + len(at), total + len(at)
            if held > 200_000:
                yield pa.RecordBatch.from_pydict({"x": np.concatenate(xs), "y": np.concatenate(ys)})
                xs, ys, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"x": np.concatenate(xs), "y": np.concatenate(ys)})
        if total > limit:
            yield pa.RecordBatch.from_pydict({"x": pa.array([key[0].as_py()], pa.int64()), "y": pa.array([None], pa.int64())})

    return of


def _open_groups(lists: DataFrame, comp: DataFrame, own: DataFrame, centers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells of the groups of lists that hold sets of two components, and the written table under them.

    Lists with one smallest member (center) are one group, in which a set is once, with its bitmap. Two
    sets of the group's largest component are joined already, so only the others (outsiders) are held
    against all members: a cell is a part of the outsiders and a part of the members. A set of the
    largest component is sent once for each part of the outsiders.
    """
    rows = lists.join(comp.withColumnRenamed("node", "x"), "x", "left").withColumn("component", F.coalesce("component", "x"))
    open_ = rows.groupBy("token").agg(F.min("x").alias("center"), F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("token", "center")
    if centers is not None:
        open_ = open_.join(centers, "center", "left_semi")
    sets = rows.join(open_, "token").groupBy("center", "x").agg(F.bit_or("info").alias("info"), F.first("component").alias("component"))
    sets = materialize(sets, "groups")
    parts = sets.groupBy("center", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("center").agg(F.max_by("component", F.struct("m", "component")).alias("largest"), F.sum("m").alias("m"), F.max("m").alias("l"))
    deal = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    parts = parts.select("center", "largest", deal(F.col("m")).alias("blocks"), deal(F.col("m") - F.col("l")).alias("chunks"))
    cells = sets.join(parts, "center").join(own.where("doc_id is not null").select(F.col("doc_id").alias("x"), "bits"), "x")
    place = lambda n: F.pmod(F.xxhash64("x"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda chunk, block, out: F.struct(chunk.alias("chunk"), block.alias("block"), F.lit(out).alias("outsider"))
    member = F.transform(every(F.col("chunks")), lambda c: cell(c, place(F.col("blocks")), False))
    outsider = F.transform(every(F.col("blocks")), lambda b: cell(place(F.col("chunks")), b, True))
    both = F.when(F.col("component") == F.col("largest"), member).otherwise(F.concat(member, outsider))
    return cells.withColumn("cell", F.explode(both)).select("center", "cell.chunk", "cell.block", "cell.outsider", "x", "info", "component", "bits"), sets


BLOOM_BITS = 1 << 23


def _members(pairs: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size over hashed ids of one side of ``pairs``."""

    def of(batches):
        bits = np.zeros(BLOOM_BITS, bool)
        for b in batches:
            bits[mix(b.column(column).to_numpy().astype(np.uint64)) % np.uint64(BLOOM_BITS)] = True
        yield pa.RecordBatch.from_pydict({"b": pa.array([squeeze(np.packbits(bits))], pa.binary())})

    bits = np.zeros(BLOOM_BITS // 8, np.uint8)
    for b in pairs.select(column).coalesce(8).mapInArrow(of, "b binary").toPandas()["b"]:
        bits |= unsqueeze(b)
    return bits


def _texts_of(docs: DataFrame, pairs: DataFrame, column: str, name: str) -> DataFrame:
    """Compressed texts of (at least) the documents on one side of ``pairs``; the bitmap spares the others the way."""
    sent = docs.sparkSession.sparkContext.broadcast(_members(pairs, column))

    def of(batches):
        member, packer = np.unpackbits(sent.value).astype(bool), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            keep = member[mix(batch.column("doc_id").to_numpy().astype(np.uint64)) % np.uint64(BLOOM_BITS)]
            batch = batch.filter(pa.array(keep))
            texts = [packer.compress(t.encode("utf-8", "surrogatepass")) for t in strings(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({column: batch.column("doc_id"), name: pa.array(texts, pa.binary())})

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, f"{column} long, {name} binary")


def _verified(docs: DataFrame, pairs: DataFrame, rule: _Rule) -> DataFrame:
    """The pairs (x, y) that are links by their whole sets, worked out again from both texts."""

    def of(batches):
        unpack_text = zstandard.ZstdDecompressor().decompress
        for b in batches:
            x, y, s, t = (b.column(c).to_pylist() for c in ("x", "y", "s", "t"))
            u, v = [], []
            for part in chunks([len(i) + len(j) for i, j in zip(s, t, strict=True)], 1 << 20):
                raw = [*{*s[part], *t[part]}]
                own = dict(zip(raw, shingle_sets([unpack_text(r).decode("utf-8", "surrogatepass") for r in raw]), strict=True))
                for i, j, one, two in zip(x[part], y[part], s[part], t[part], strict=True):
                    if rule.links(own[one], own[two]):
                        u.append(i)
                        v.append(j)
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    left, right = _texts_of(docs, pairs, "x", "s"), _texts_of(docs, pairs, "y", "t")
    hot = pairs.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_SIDE).select("x", F.ceil(F.col("n") / HOT_SIDE).cast("int").alias("parts"))
    one = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(hot, "x", "left").select("x", "y", F.pmod(F.xxhash64("y"), one).cast("int").alias("part"))
    left = left.join(hot, "x", "left").select("x", "s", F.explode(F.sequence(F.lit(0), one - 1)).alias("part"))
    return dealt.join(right, "y").join(left, ["x", "part"]).select("x", "y", "s", "t").mapInArrow(of, "u long, v long")


def near_duplicates(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """Components of the documents whose 5-word shingle sets have a Jaccard similarity of num/den or more.

    ``docs`` needs doc_id (integers) and text; other columns are not looked at. Returns, for each row,
    doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own if none). Repeated
    rows are repeated in the result; rows of one doc_id with different texts are one document, linked if
    any of its texts is, with the n_shingles of each.
    Null texts and texts without words have 0 shingles and no links, copies are always linked, and
    a row of null doc_id has its text's component, null if no other row shares the set. An empty table gives an empty table.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs.select("doc_id", "text"), _Rule(num, den))


def _near_duplicates(docs: DataFrame, rule: _Rule) -> DataFrame:
    spark = docs.sparkSession
    _, n_bytes = text_size(docs)
    fps, counts, bits, others = _frequent(docs, n_bytes)
    hot = spark.sparkContext.broadcast((fps, counts, bits))
    own = materialize(_prefixes(docs, rule, hot), "sets")
    reps = own.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.min_by("blob", "doc_id").alias("blob"))
    light = _boundary(rule, others)
    ranges = max(12, n_bytes // RANGE_BYTES)
    lists = _postings(reps.select("rep", "n", "blob"), rule, light, hot, ranges)
    found = materialize(lists.groupBy("r").applyInPandas(_candidates(rule, hot, light), "token long, x long, y long, often long, enough long, list boolean"), "lists")

    seen = found.where("not list").groupBy("x", "y").agg(F.sum("often").alias("often"), F.min("enough").alias("enough"))
    tried = materialize(seen.where("often >= enough").select("x", "y"), "pairs")
    links = materialize(_verified(docs, tried, rule), "links")
    comp = components(links)

    lists = found.where("list").select("token", "x", F.col("y").alias("info"))
    done, centers = [found, tried, links], None
    for whole in (False, True):
        cells, sets = _open_groups(lists, comp, own, centers)
        todo = cells.groupBy("center", "chunk", "block").applyInArrow(_remaining(rule, whole), "x long, y long")
        todo = materialize(todo, "pairs")
        rest = materialize(todo.where("y is not null").distinct().join(tried, ["x", "y"], "left_anti"), "pairs")
        done += [sets, todo, rest]
        if not rest.isEmpty():
            tried = tried.unionByName(rest)
            links = materialize(_verified(docs, rest, rule), "links")
            done += [links, comp]
            comp = components(links.unionByName(comp.select(F.col("node").alias("u"), F.col("component").alias("v"))))
        centers = todo.where("y is null").select(F.col("x").alias("center")).distinct()
        if centers.isEmpty():
            break
    discard(*done)
    hot.unpersist()

    member = own.where("n > 0").select("doc_id", "n", "digest")
    rep = reps.select("digest", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    joined = member.join(rep, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return joined.unionByName(own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
