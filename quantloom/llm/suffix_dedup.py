"""Exact substring de-duplication with a distributed, sparse suffix array.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id.
Sorting every suffix would shuffle the corpus many times over, so the array holds the suffixes at
anchors only: each 50-byte window chooses the smallest hashed 16-byte gram in it, and equal windows
choose alike, so that two equal windows meet as suffixes with equal leading grams and equal bytes
before them.

1. Anchors' fingerprints (about 5 % of the positions, some 3 bytes each) meet by range; those that
   two documents or more have are reported to these documents.
2. Their suffixes, with the bytes that their windows have left of them, are range-partitioned by their
   leading 8 bytes at splitters sampled from the corpus. A leading token that fills several ranges is
   dealt over them by document.
3. Each bucket sorts its suffixes locally by multikey (word-wise) sorting, once rightwards and once
   leftwards; runs whose longest common prefixes reach far enough on both sides are the classes of equal
   windows, and all but the smallest document's are marked.
4. What a bucket couldn't decide because its leading token crosses a bucket boundary (one document
   for each class and bucket) is compared across the boundaries in the same way.

A window is held against all others at every size: nothing is capped or sampled but the splitters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quantloom.llm.common import by_range, chunks, frame, join_packed, materialize, mix, pack, prefix_hash, quoted, small_batches, span_hash, squeeze, strings, text_size, unsqueeze

SPAN, GRAM = 50, 16
_SLIDE = SPAN - GRAM + 1
_LEFT = _SLIDE - 1
_POS_BITS = 20
_SEGMENT = 1 << _POS_BITS
#: Text for each range of leading tokens, and the fewest and most ranges.
RANGE_BYTES, RANGES = 4 << 20, (64, 1 << 20)
#: Leading tokens that the driver samples for each range (8 bytes each, 16 MB at most), and at most from one document.
SAMPLE_KEYS, SAMPLE_MOST, SAMPLE_OF_DOCUMENT = 32, 2_000_000, 50
#: Text that a task holds to deal it out compressed.
DEAL_BYTES = 8 << 20
_U = np.uint64


class Anchors:
    """The anchors of a chunk of byte strings: owner, place in its string, range of window offsets, fingerprint."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"".join(texts) + bytes(SPAN), np.uint8)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.begin = np.concatenate(([0], ends[:-1]))
        found = [self._segment(s, ends) for s in range(0, max(0, len(self.buf) - 2 * SPAN + 1), _SEGMENT - SPAN + 1)]
        self.at, self.lo, self.hi, self.fp = (np.concatenate([f[k] for f in found]) if found else np.empty(0, t) for k, t in enumerate((np.int64, np.int64, np.int64, _U)))
        self.owner = np.searchsorted(ends, self.at, "right")

    def _segment(self, begin: int, ends: np.ndarray):
        buf = self.buf[begin : min(begin + _SEGMENT, len(self.buf) - SPAN)]
        run = prefix_hash(buf)
        place = np.arange(len(buf) - GRAM + 1)
        key = span_hash(run, place, place + GRAM)
        key = (key >> _U(_POS_BITS) << _U(_POS_BITS)) | place.astype(_U)
        low, wide = key, 1
        while wide * 2 <= _SLIDE:
            low = np.minimum(low[:-wide], low[wide:])
            wide *= 2
        low = np.minimum(low[: len(key) - _SLIDE + 1], low[_SLIDE - wide :])
        inner = ends[(ends > begin) & (ends < begin + len(low) + SPAN - 1)] - begin
        step = np.zeros(len(low) + SPAN + 1, np.int32)
        np.add.at(step, np.maximum(0, inner - SPAN + 1), 1)
        np.add.at(step, inner, -1)
        good = np.cumsum(step[: len(low)]) == 0
        p = np.flatnonzero(good)
        chosen = low[p]
        new = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1]))) if len(p) else np.empty(0, np.int64)
        last = np.append(new[1:], len(p)) - 1 if len(p) else new
        at = (chosen[new] & _U(_SEGMENT - 1)).astype(np.int64)
        return at + begin, at - p[last], at - p[new], chosen[new] >> _U(_POS_BITS)

    def lead(self, which) -> np.ndarray:
        """The first 8 bytes of the suffixes, so that numbers sort as bytes do."""
        return np.ascontiguousarray(self.buf[self.at[which][:, None] + np.arange(8)]).view(">u8").reshape(-1).astype(_U)

    def context(self, which) -> np.ndarray:
        """The bytes around each anchor that its windows can reach."""
        step = np.arange(-_LEFT, SPAN)
        rows = self.buf[np.clip(self.at[which][:, None] + step, 0, len(self.buf) - 1)]
        rows[(step < -self.hi[which][:, None]) | (step >= SPAN - self.lo[which][:, None])] = 0  # no window holds these
        return np.ascontiguousarray(rows).view(f"V{_LEFT + SPAN}").reshape(-1)


def tag_of(text: bytes) -> int:
    """Spark's ``xxhash64`` of a text."""
    return int(np.uint64(xxhash.xxh64_intdigest(text, seed=42)).view(np.int64))


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in strings(batch.column("text"))]


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Where a document's text, reports and verdicts meet."""
    return (mix(ids.astype(np.int64).view(_U)) % _U(buckets)).astype(np.int32)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal neighbours."""
    if len(keys):
        cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        yield from zip(cut.tolist(), np.append(cut[1:], len(keys)).tolist(), strict=True)


def _dealt(docs: DataFrame, buckets: int, rest: tuple[str, ...] = ()) -> DataFrame:
    """b, ids, sizes, texts, rest: the documents by bucket, many in a row and compressed together; other columns as an Arrow stream."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[tuple[int, bytes]], others: list[pa.RecordBatch]) -> pa.RecordBatch:
            ids = np.array([k for k, _ in held], np.int64)
            b = _bucket(ids, buckets)
            order = np.argsort(b, kind="stable")
            b, texts = b[order], [held[k][1] for k in order.tolist()]
            table = pa.Table.from_batches(others).take(order) if others else None
            rows = [(int(b[i]), squeeze(ids[order[i:j]]), squeeze(np.array([len(t) for t in texts[i:j]], np.int64)), squeeze(np.frombuffer(b"".join(texts[i:j]), np.uint8)), _stream(table.slice(i, j - i)) if others else None) for i, j in _runs(b)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["b", "ids", "sizes", "texts", "rest"])

        held, others, total = [], [], 0
        for batch in batches:
            texts = _bytes(batch)
            for part in chunks([len(t) + 64 for t in texts], DEAL_BYTES):
                ids = batch.column(0).slice(part.start, part.stop - part.start).to_pylist()
                held += zip(ids, texts[part], strict=True)
                if rest:
                    others.append(batch.slice(part.start, part.stop - part.start).select(batch.schema.names[2:]))
                total += sum(len(t) + 64 for t in texts[part])
                if total > DEAL_BYTES:
                    yield flush(held, others)
                    held, others, total = [], [], 0
        if held:
            yield flush(held, others)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(quoted(c).alias(f"_{k}") for k, c in enumerate(rest)))
    return named.mapInArrow(of, "b int, ids binary, sizes binary, texts binary, rest binary")


def _stream(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _undealt(table: pa.Table) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Documents of a bucket again: ids and texts, a row at a time."""
    for ids, sizes, texts in zip(*(table.column(c).to_pylist() for c in ("ids", "sizes", "texts")), strict=True):
        ends, raw = np.cumsum(unsqueeze(sizes)).tolist(), unsqueeze(texts).tobytes()
        yield unsqueeze(ids), [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _by_document(blobs) -> dict[int, list[np.ndarray]]:
    """Columns of packed (doc, ...) rows, by document."""
    blobs = [*blobs]
    if not blobs:
        return {}
    cols = join_packed(blobs)
    order = np.argsort(cols[0], kind="stable")
    cols = [c[order] for c in cols]
    return {int(cols[0][i]): [c[i:j] for c in cols[1:]] for i, j in _runs(cols[0])}


def _repeated(docs: DataFrame, n_bytes: int, buckets: int) -> tuple[DataFrame, int]:
    """(b, blob): documents and fingerprints of anchors that another document has too; and the bits cut off them."""
    bits = min(64 - _POS_BITS, max(32, int(n_bytes).bit_length() + 4))
    ranges = max(12, n_bytes // (16 << 20))
    shift = _U(64 - _POS_BITS - bits)

    def collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[tuple]) -> pa.RecordBatch:
            fp, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, fp))
            fp, doc = fp[order], doc[order]
            keep = np.concatenate(([True], (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])))
            fp, doc = fp[keep], doc[keep]
            first = np.concatenate(([True], fp[1:] != fp[:-1]))
            size = np.diff(np.append(np.flatnonzero(first), len(fp)))
            near = np.repeat(size > 1, size)  # known here already: one of them is enough for the others
            rows = [(-1 - int(fp[near][0] % _U(ranges)), pack(fp[near] >> shift, doc[near]))] if near.any() else []
            fp, doc = fp[first] >> shift, doc[first]
            rows += [(r, pack(fp[a:b], doc[a:b])) for r, a, b in by_range(fp, ranges, bits)]
            return pa.RecordBatch.from_pydict({"r": pa.array([r for r, _ in rows], pa.int32()), "blob": pa.array([b for _, b in rows], pa.binary())})

        held: list[tuple] = []
        total = 0
        for batch in batches:
            texts, ids = _bytes(batch), batch.column("doc_id").to_numpy()
            for part in chunks([len(t) for t in texts]):
                a = Anchors(texts[part])
                if len(a.at):
                    held.append((a.fp, ids[part][a.owner]))
                    total += len(a.at)
                if total >= 400_000:
                    yield flush(held)
                    held, total = [], 0
        if total:
            yield flush(held)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, doc = join_packed(pdf["blob"])
        if pdf["r"].iat[0] >= 0:
            order = np.argsort(fp, kind="stable")
            fp, doc = fp[order], doc[order]
            same = fp[1:] == fp[:-1]
            keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            fp, doc = fp[keep], doc[keep]
        b = _bucket(doc, buckets)
        order = np.lexsort((fp, doc, b))
        fp, doc, b = fp[order], doc[order], b[order]
        found = [(int(b[i]), pack(doc[i:j], fp[i:j])) for i, j in _runs(b)]
        return frame({"b": [k for k, _ in found], "blob": [x for _, x in found]}, ["b", "blob"])

    return docs.mapInArrow(collect, "r int, blob binary").groupBy("r").applyInPandas(meet, "b int, blob binary"), int(shift)


def _splitters(docs: DataFrame, n_docs: int, ranges: int) -> np.ndarray:
    """Sampled leading tokens that cut the suffixes into even ranges."""

    def lead(batches):
        for batch in batches:
            for text in _bytes(batch):
                a = Anchors([text])
                keys = a.lead(slice(None))
                keys = keys[np.argsort(mix(a.at.astype(_U)))][:SAMPLE_OF_DOCUMENT]
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys.astype(np.int64))})

    want = min(SAMPLE_MOST, max(100_000, SAMPLE_KEYS * ranges)) // SAMPLE_OF_DOCUMENT
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n_docs))) < want)
    keys = np.sort(sample.mapInArrow(lead, "key long").toArrow()["key"].to_numpy().view(_U))
    return keys[np.arange(1, ranges) * len(keys) // ranges] if len(keys) else np.empty(0, _U)


def _suffixes(texts: DataFrame, marked: DataFrame, shift: int, splitters: np.ndarray) -> DataFrame:
    """Packed suffixes with their left context, by range of their leading token."""

    def flush(held: list[tuple]) -> list[tuple[int, bytes]]:
        key, ctx, doc, tag, at, lo, hi = (np.concatenate(x) for x in zip(*held, strict=True))
        low, high = np.searchsorted(splitters, key, "left"), np.searchsorted(splitters, key, "right")
        r = np.where(high - low > 1, low + 1 + mix(doc.astype(_U)).astype(np.int64) % np.maximum(1, high - low), high)
        order = np.lexsort((key, r))
        r, cols = r[order], [x[order] for x in (key, ctx, doc, tag, at, lo, hi)]
        return [(int(r[i]), pack(*(x[i:j] for x in cols))) for i, j in _runs(r)]

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        known, held, rows, total = _by_document(right.column("blob").to_pylist()), [], [], 0
        for ids, texts in _undealt(left):
            for part in chunks([len(t) for t in texts]):
                a = Anchors(texts[part])
                own = ids[part]
                first = np.searchsorted(a.owner, np.arange(len(own) + 1))
                keep = np.zeros(len(a.at), bool)
                for k, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if (fps := known.get(int(own[k]))) is not None:
                        keep[i:j] = np.isin(a.fp[i:j] >> _U(shift), fps[0])
                keep = np.flatnonzero(keep)
                if len(keep):
                    owner = a.owner[keep]
                    tags = np.zeros(len(own), np.int64)
                    for k in np.unique(owner).tolist():
                        tags[k] = tag_of(texts[part][k])
                    held.append((a.lead(keep), a.context(keep), own[owner], tags[owner], a.at[keep] - a.begin[owner], a.lo[keep].astype(np.uint8), a.hi[keep].astype(np.uint8)))
                    total += len(keep)
                if total >= 150_000:
                    rows += flush(held)
                    held, total = [], 0
        if total:
            rows += flush(held)
        return pa.table({"r": pa.array([r for r, _ in rows], pa.int32()), "blob": pa.array([x for _, x in rows], pa.binary())})

    return texts.groupBy("b").cogroup(marked.groupBy("b")).applyInArrow(of, "r int, blob binary")


def multikey_sort(rows: np.ndarray) -> np.ndarray:
    """Order of equally long byte strings: word by word, sorting on only where all words so far are equal."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8")
    order = np.argsort(words[:, 0].astype(_U), kind="stable")
    group = np.zeros(n, np.int64)
    active = np.arange(n)
    for k in range(words.shape[1]):
        word = words[order[active], k].astype(_U)
        if k:
            again = np.lexsort((word, group[active]))
            order[active], word = order[active][again], word[again]
        g = group[active]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (word[1:] != word[:-1])))
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(active)))
        group[active] = np.repeat(active[begin], size)
        active = active[np.repeat(size > 1, size)]
        if not len(active):
            break
    return order


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the order, the bytes that its string shares with the one before (-1 at the first)."""
    width = rows.shape[1]
    out = np.full(len(order), -1, np.int16)
    for a in range(1, len(order), 200_000):
        b = min(len(order), a + 200_000)
        differ = rows[order[a:b]] != rows[order[a - 1 : b - 1]]
        out[a:b] = np.where(differ.any(1), differ.argmax(1), width)
    return out


def decide(ctx: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first and last marked window offset of each suffix (last < first: none), and whether one is unmarked."""
    raw = ctx.view(np.uint8).reshape(-1, _LEFT + SPAN)
    first, last, open_ = np.full(len(doc), _SLIDE, np.int64), np.full(len(doc), -1, np.int64), np.zeros(len(doc), bool)
    right, left = np.ascontiguousarray(raw[:, _LEFT:]), np.ascontiguousarray(raw[:, _LEFT - 1 :: -1])
    order_r, order_l = multikey_sort(right), multikey_sort(left)
    lcp_r, lcp_l = _common(right, order_r), _common(left, order_l)
    n = len(doc)
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(_SLIDE):
        at = np.flatnonzero((lo <= a) & (a <= hi))
        if not len(at):
            continue
        class_r[order_r] = np.cumsum(lcp_r < SPAN - a)
        class_l[order_l] = np.cumsum(lcp_l < a)
        key = class_r[at] * (n + 1) + class_l[at]
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        least = np.repeat(np.minimum.reduceat(doc[at], begin), np.diff(np.append(begin, len(at))))
        marked = doc[at] > least
        first[at[marked]] = np.minimum(first[at[marked]], a)
        last[at[marked]] = a
        open_[at[~marked]] = True
    return first, last, open_


def _buckets(splitters: np.ndarray | None, buckets: int):
    """Verdicts of a bucket (kind 0: marked ranges by documents' buckets), and what crosses its boundary (kind 1)."""
    wide = np.unique(splitters[1:][splitters[1:] == splitters[:-1]]) if splitters is not None and len(splitters) else np.empty(0, _U)

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        key, ctx, doc, tag, at, lo, hi = join_packed(pdf["blob"])
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.concatenate(([True], key[1:] != key[:-1]))
        size = np.diff(np.append(np.flatnonzero(begin), len(key)))
        keep = np.repeat(size > 1, size) | np.isin(key, wide)
        order, key = order[keep], key[keep]
        ctx, doc, tag, at, lo, hi = (x[order] for x in (ctx, doc, tag, at, lo, hi))
        kind, ids, blobs = [], [], []
        # whole runs of equal leading tokens, some 100,000 suffixes at a time
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        cut = [*cut[np.unique(np.searchsorted(cut, np.arange(0, len(key), 100_000)).clip(0, len(cut) - 1))].tolist(), len(key)] if len(key) else [0]
        spans = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            first, last, open_ = decide(ctx[a:b], doc[a:b], lo[a:b], hi[a:b])
            hit = last >= 0
            spans.append((doc[a:b][hit], tag[a:b][hit], at[a:b][hit] - last[hit], at[a:b][hit] - first[hit] + SPAN))
            for k in np.flatnonzero(np.isin(wide, key[a:b])):
                own = np.flatnonzero((key[a:b] == wide[k]) & open_) + a
                if len(own):
                    kind.append(1)
                    ids.append(int(wide[k].view(np.int64)))
                    blobs.append(pack(*(x[own] for x in (key, ctx, doc, tag, at, lo, hi))))
        if spans:
            d, g, s, e = (np.concatenate(x) for x in zip(*spans, strict=True))
            order = np.lexsort((s, g, d))
            d, g, s, e = d[order], g[order], s[order], e[order]
            text = np.cumsum(np.concatenate(([False], (d[1:] != d[:-1]) | (g[1:] != g[:-1])))) if len(d) else d
            runs = [(i, *merged(s[i:j], e[i:j])) for i, j in _runs(text)]
            at_ = np.concatenate([np.full(len(x[1]), x[0]) for x in runs] or [np.empty(0, np.int64)])
            d, g = d[at_], g[at_]
            s, e = (np.concatenate([x[k] for x in runs] or [np.empty(0, np.int64)]) for k in (1, 2))
            b = _bucket(d, buckets)
            order = np.argsort(b, kind="stable")
            d, g, s, e, b = d[order], g[order], s[order], e[order], b[order]
            for i, j in _runs(b):
                kind.append(0)
                ids.append(int(b[i]))
                blobs.append(pack(d[i:j], g[i:j], s[i:j], e[i:j]))
        return frame({"kind": kind, "id": ids, "blob": blobs}, ["kind", "id", "blob"])

    return of


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges sorted by start, as the maximal runs that they cover; ranges that touch are one run."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Remove each byte covered by a 50-byte string that also starts in a document with a smaller doc_id.

    ``docs`` needs doc_id (integers) and text; other columns are not looked at. Returns, for each row,
    doc_id, n_bytes (UTF-8; null text: 0), spans (the maximal removed runs, [start, end) in bytes),
    kept (the remaining bytes) and text_hash (``xxhash64`` of the text, to tell rows of one doc_id apart;
    these and repeated rows remove nothing from each other). Strings are judged on the input, overlaps count, matches never
    cross documents. Texts under 50 bytes stay. Rows of null doc_id stay as they are and remove
    nothing elsewhere. An empty table gives an empty table.
    """
    with small_batches(docs.sparkSession):
        return _remove_repeats(docs)


def remove_in_place(docs: DataFrame) -> DataFrame:
    """The documents without the bytes that :func:`remove_repeats` removes; all columns as they are.

    What is left of a cut character goes too; n_chars, if there, is that of the new text where bytes went.
    Rows of null doc_id and null texts stay as they are. Other columns travel with the texts.
    """
    with small_batches(docs.sparkSession):
        return _remove_repeats(docs, tuple(docs.columns))


def _found(docs: DataFrame) -> tuple[int, DataFrame]:
    """The number of buckets, and (b, blob) of all ranges to remove."""
    n_docs, n_bytes = text_size(docs)
    buckets = int(max(12, n_bytes // (16 << 20)))
    marked, shift = _repeated(docs, n_bytes, buckets)
    splitters = _splitters(docs, n_docs, min(RANGES[1], max(RANGES[0], n_bytes // RANGE_BYTES)))
    rows = "kind int, id long, blob binary"
    suffixes = _suffixes(_dealt(docs, buckets), marked, shift, splitters)
    found = materialize(suffixes.groupBy("r").applyInPandas(_buckets(splitters, buckets), rows), "repeats")
    across = found.where("kind = 1").groupBy("id").applyInPandas(_buckets(None, buckets), rows)
    return buckets, found.where("kind = 0").unionByName(across).select(F.col("id").cast("int").alias("b"), "blob")


def _remove_repeats(docs: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    named, unnamed = docs.where("doc_id is not null"), docs.where("doc_id is null")
    buckets, spans = _found(named.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def cut(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
        """(doc_id, text, ranges, what is kept, text_hash) of a bucket's documents."""
        known = _by_document(right.column("blob").to_pylist())
        for ids, own in _undealt(left):
            for doc, text in zip(ids.tolist(), own, strict=True):
                runs, kept, tag = [], text, tag_of(text)
                if doc in known and (mine := known[doc][0] == tag).any():
                    s, e = known[doc][1][mine], known[doc][2][mine]
                    order = np.argsort(s, kind="stable")
                    s, e = (x.tolist() for x in merged(s[order], e[order]))
                    runs = [*zip(s, e, strict=True)]
                    kept = b"".join(text[a:b] for a, b in zip([0, *e], [*s, len(text)], strict=True))
                yield doc, text, runs, kept, tag

    def described(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [(doc, len(text), [{"start": a, "end": b} for a, b in runs], kept, tag) for doc, text, runs, kept, tag in cut(left, right)]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.int64())
        cols = [*zip(*rows, strict=True)] or [()] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "spans", "kept", "text_hash"])

    if columns:
        rest = tuple(c for c in columns if c != "text")
        chars = rest.index("n_chars") if "n_chars" in rest else None
        schema = T.StructType([T.StructField(f"_{k}", docs.schema[c].dataType) for k, c in enumerate(rest)]).add("text", "string")
        kind = to_arrow_type(docs.schema["n_chars"].dataType) if chars is not None else None

        def rebuilt(left: pa.Table, right: pa.Table) -> pa.Table:
            others = [pa.ipc.open_stream(x).read_all() for x in left.column("rest").to_pylist()]
            table = pa.concat_tables(others) if others else None
            found = [(kept.decode("utf-8", "ignore") if runs else text.decode("utf-8", "surrogatepass"), bool(runs)) for _, text, runs, kept, _ in cut(left, right)]
            if table is None:
                return pa.table({f.name: pa.array([], to_arrow_type(f.dataType)) for f in schema.fields})
            if chars is not None:
                old = table.column(f"_{chars}").to_pylist()
                new = [len(t) if hit else n for (t, hit), n in zip(found, old, strict=True)]
                table = table.set_column(chars, f"_{chars}", pa.array(new, kind))
            return table.append_column("text", pa.array([t for t, _ in found], pa.string()))

        texts = _dealt(named.where("text is not null"), buckets, rest)
        out = texts.groupBy("b").cogroup(spans.groupBy("b")).applyInArrow(rebuilt, schema)
        names = {c: f"_{k}" for k, c in enumerate(rest)}
        out = out.select(*(F.col(names.get(c, "text")).alias(c) for c in columns))
        return out.unionByName(docs.where("doc_id is null or text is null").select(*map(quoted, columns)))
    texts = _dealt(named, buckets)
    out = texts.groupBy("b").cogroup(spans.groupBy("b")).applyInArrow(described, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary, text_hash long")
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    whole = unnamed.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(raw).cast("long").alias("n_bytes"), F.array().cast(out.schema["spans"].dataType).alias("spans"), raw.alias("kept"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return out.unionByName(whole)
