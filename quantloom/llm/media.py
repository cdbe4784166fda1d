"""Media columns: ISO base media files as binary values.

:func:`probe` walks the nested boxes of a file, decodes the sample tables and gives codec, duration
and the byte ranges of keyframes; it never looks into ``mdat``. :func:`samples` reads the payload
through the same tables. :func:`build` writes a file with one track of uncompressed frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import chunks, materialize, strings

#: A frame is 8 by 8 pixels of three 8-bit samples; every 16th starts a chunk and is a keyframe.
SIDE, FRAME, CHUNK, RATE = 8, 192, 16, 25
_CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"moof", b"traf", b"mvex", b"udta"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class MediaError(ValueError):
    """A file whose boxes or tables contradict each other."""


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0, version: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def build(payload: bytes) -> bytes:
    """A file of one track of raw frames; the payload's length is a positive multiple of ``FRAME``.

    No time of writing is stored, so equal payloads give equal files.
    """
    n, rest = divmod(len(payload), FRAME)
    if rest or not n:
        raise MediaError(f"{len(payload)} bytes are no positive multiple of {FRAME}")
    full, last = divmod(n, CHUNK)
    count = full + bool(last)
    entry = struct.pack(">6xH16xHHIIIH32xHh", 1, SIDE, SIDE, 0x480000, 0x480000, 0, 1, 24, -1)
    runs = [(1, CHUNK, 1)] * bool(full) + [(full + 1, last, 1)] * bool(last)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2mp41")

    def moov(base: int) -> bytes:
        at = base + np.arange(count, dtype=np.uint64) * np.uint64(CHUNK * FRAME)
        wide = base + len(payload) >= 1 << 32
        tables = [
            _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", entry)),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(">I", count), (np.arange(count) * CHUNK + 1).astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", count), at.astype(">u8" if wide else ">u4").tobytes()),
        ]
        info = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), _box(b"stbl", *tables))
        media = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), _full(b"hdlr", struct.pack(">4x4s12x", b"vide"), b"\0"), info)
        head = _full(b"tkhd", struct.pack(">IIIII8xhhhH", 0, 0, 1, 0, n, 0, 0, 0, 0), _MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7)
        movie = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", movie, _box(b"trak", head, media))

    size = len(ftyp) + len(moov(0))
    while len(ftyp) + len(moov(size + 16)) != size:  # wider offsets make a larger table
        size = len(ftyp) + len(moov(size + 16))
    lead = 8 if len(payload) + 8 < 1 << 32 else 16
    return b"".join([ftyp, moov(size + lead), _box(b"mdat", payload)])


def boxes(data, begin: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the contents of each box between two places."""
    end = len(data) if end is None else end
    while begin < end:
        if end - begin < 8:
            raise MediaError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, begin)
        head = 8
        if size == 1:
            if end - begin < 16:
                raise MediaError("a box header is cut off")
            size, head = struct.unpack_from(">Q", data, begin + 8)[0], 16
        elif size == 0:
            size = end - begin
        if size < head or begin + size > end:
            raise MediaError(f"box {kind!r} does not fit")
        yield kind, begin + head, begin + size
        begin += size


@dataclass
class Track:
    """What a track's boxes say."""

    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    width: int = 0
    height: int = 0
    tables: dict = field(default_factory=dict)


def _array(data, begin: int, end: int, kind: str, per: int) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, begin + 4)
    width = np.dtype(kind).itemsize * per
    if begin + 8 + n * width > end:
        raise MediaError("a table is cut off")
    return np.frombuffer(data, kind, n * per, begin + 8).astype(np.int64).reshape(n, per)


def _track(data, begin: int, end: int, out: Track) -> Track:
    for kind, a, b in boxes(data, begin, end):
        if kind in _CONTAINERS:
            _track(data, a, b, out)
        elif kind == b"hdlr":
            out.handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"mdhd":
            out.timescale, out.duration = struct.unpack_from(">IQ" if data[a] else ">II", data, a + (20 if data[a] else 12))
        elif kind == b"stsd":
            entry = next(boxes(data, a + 8, b), None)
            if entry:
                out.codec = entry[0].decode("latin-1")
                if out.handler in ("vide", "") and entry[2] - entry[1] >= 28:
                    out.width, out.height = struct.unpack_from(">HH", data, entry[1] + 24)
        elif kind in (b"stts", b"stsc", b"stss", b"stco", b"co64"):
            per = {b"stts": 2, b"stsc": 3}.get(kind, 1)
            out.tables["stco" if kind == b"co64" else kind.decode()] = _array(data, a, b, ">u8" if kind == b"co64" else ">u4", per)
        elif kind == b"stsz":
            size, n = struct.unpack_from(">II", data, a + 4)
            if not size and a + 12 + 4 * n > b:
                raise MediaError("a table is cut off")
            out.tables["stsz"] = np.full(n, size, np.int64) if size else np.frombuffer(data, ">u4", n, a + 12).astype(np.int64)
    return out


def tracks(data: bytes) -> list[Track]:
    """All tracks of a file, from its boxes; media data is stepped over."""
    try:
        return [_track(data, a, b, Track()) for kind, i, j in boxes(data) if kind == b"moov" for sub, a, b in boxes(data, i, j) if sub == b"trak"]
    except (struct.error, IndexError) as e:
        raise MediaError(str(e)) from e


def sample_ranges(track: Track) -> tuple[np.ndarray, np.ndarray]:
    """Place and size in the file of every sample, from the chunk and size tables."""
    size, chunk = track.tables.get("stsz", np.empty(0, np.int64)), track.tables.get("stco", np.empty((0, 1), np.int64))[:, 0]
    runs = track.tables.get("stsc", np.empty((0, 3), np.int64))
    if not len(size):
        return size, size
    if not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any():
        raise MediaError("the chunk table does not start at chunk 1 or does not ascend")
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0] - 1, max(len(chunk), runs[-1, 0] - 1))))[: len(chunk)]
    if per.sum() != len(size):
        raise MediaError(f"chunks hold {per.sum()} samples, sizes are given for {len(size)}")
    before = np.concatenate(([0], np.cumsum(size)[:-1]))
    first = np.concatenate(([0], np.cumsum(per)[:-1]))
    return np.repeat(chunk - before[np.minimum(first, len(size) - 1)], per) + before, size


def keyframes(track: Track) -> tuple[np.ndarray, np.ndarray]:
    """Place and size of the samples that decoding can start at (all, if no table names them)."""
    at, size = sample_ranges(track)
    if "stss" in track.tables:
        k = track.tables["stss"][:, 0] - 1
        if len(k) and (k[0] < 0 or k[-1] >= len(at)):
            raise MediaError("a keyframe is no sample")
        at, size = at[k], size[k]
    return at, size


def samples(data: bytes, track: Track) -> bytes:
    """A track's samples, end to end."""
    at, size = sample_ranges(track)
    if len(at) and (at.min() < 0 or (at + size).max() > len(data)):
        raise MediaError("a sample lies outside the file")
    joint = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + size[:-1]))) if len(at) else np.empty(0, np.int64)
    last = np.append(joint[1:], len(at)) - 1
    return b"".join(data[a:b] for a, b in zip(at[joint].tolist(), (at[last] + size[last]).tolist(), strict=True))


PROBE = "codec string, duration double, width int, height int, n_samples long, keyframes array<struct<begin: long, size: long>>, error string"


def _probe(data: bytes | None) -> dict:
    out = dict.fromkeys(("codec", "duration", "width", "height", "n_samples", "keyframes", "error"))
    try:
        found = tracks(data or b"")
        track = next((t for t in found if t.handler == "vide"), found[0] if found else None)
        if track is None:
            raise MediaError("no track")
        out |= _described(track)
    except MediaError as e:
        out["error"] = str(e)
    return out


def _described(track: Track) -> dict:
    at, size = keyframes(track)
    return {
        "codec": track.codec, "duration": track.duration / track.timescale if track.timescale else None, "width": track.width, "height": track.height,
        "n_samples": len(track.tables.get("stsz", ())), "keyframes": [{"begin": a, "size": s} for a, s in zip(at.tolist(), size.tolist(), strict=True)],
    }


def probe(rows: DataFrame, column: str = "media") -> DataFrame:
    """Append codec, duration (seconds), width, height, n_samples, keyframes and error to rows with a media column.

    The first video track counts, else the first track. A null value or a file whose boxes don't fit
    gets nulls and what is wrong with it in ``error``; other rows are not affected.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(PROBE)
    names = [f.name for f in added]
    if clash := set(names) & set(rows.columns):
        raise ValueError(f"columns in use: {sorted(clash)}")
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in added]

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_probe(x) for x in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([f[n] for f in found], k) for n, k in zip(names, kinds, strict=True))], [*b.schema.names, *names])

    return rows.mapInArrow(of, StructType([*rows.schema.fields, *added.fields]))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text (null: empty) as UTF-8, padded with spaces to a positive multiple of 192."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in strings(b.column("text"))]
            for part in chunks([len(t) for t in texts], 8 << 20):
                media = [build(t.ljust(max(1, -(-len(t) // FRAME)) * FRAME)) for t in texts[part]]
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").slice(part.start, part.stop - part.start), "n_bytes": pa.array([len(t) for t in texts[part]], pa.int64()), "media": pa.array(media, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, n_bytes long, media binary")


COLUMNS = "codec string, duration double, keyframes array<struct<begin: long, size: long>>"


def read_back(stored: DataFrame) -> DataFrame:
    """Digests of what stored media files hold, read through their sample tables, a line of features, codec, duration and keyframe byte ranges."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = pa.list_(pa.struct([("begin", pa.int64()), ("size", pa.int64())]))
        kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "codec": pa.string(), "duration": pa.float64(), "keyframes": ranges}
        for b in batches:
            rows = []
            for data in b.column("media").to_pylist():
                (track,) = tracks(data)
                payload, seen = samples(data, track), _described(track)
                keys = seen["keyframes"]
                seconds = "-" if seen["duration"] is None else f"{seen['duration']:.2f}"
                ends = " ".join(f"{n}={k['begin']}+{k['size']}" for n, k in (("first", keys[0]), ("last", keys[-1])))
                feature = f"{track.codec.strip()} {track.width}x{track.height} {seconds}s samples={seen['n_samples']} keyframes={len(keys)} {ends}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, track.codec, seen["duration"], keys))
            cols = [*zip(*rows, strict=True)] or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *map(pa.array, cols, kinds.values())], ["doc_id", "n_bytes", *kinds])

    return stored.mapInArrow(of, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, " + COLUMNS)


def media_round_trip(docs: DataFrame) -> DataFrame:
    """Store every whole text as a media file in the shared folder, read the files back and describe them.

    Null and empty texts are 192 spaces; equal texts give equal values; columns other than doc_id
    and text are not looked at. An empty table gives an empty table.
    """
    return read_back(materialize(store_texts(docs), "media"))
