"""What the corpus operators share: durable intermediate tables, packed blobs, hashed words."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Bytes of text that one NumPy pass holds; its 64-bit work arrays take eight times as much each.
CHUNK_BYTES = 1 << 20




def _return_freed_memory() -> None:
    """Make this process (driver or reused Python worker) give large freed buffers back to the system at once.

    A worker serves many tasks of many stages; glibc and Arrow's pool would keep the largest stage's buffers.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, fixed instead of growing
        libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # no glibc
        pass


_return_freed_memory()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the cluster's shared folder; a local one only on a local master where none is set (tests)."""
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that driver and executors share")
        base = tempfile.gettempdir() + "/quantloom"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: A key with more than a 100th of the rows is joined where its rows are; there are fewer than 100 such keys.
HUB_SHARE, HUB_LEAST = 100, 5_000


def join_hubs(left: DataFrame, right: DataFrame, keys: list[str], total: int | None = None) -> DataFrame:
    """Inner join with ``right``, one row for each key whose ``n`` says how many rows of ``left`` have it.

    The rows of very frequent keys are not shuffled: no key's rows meet in one task. What is broadcast
    has a proven bound, as fewer than ``HUB_SHARE`` keys can each have so large a share of ``total``
    (the sum of n, if not given). ``right`` is read several times and should be a written table.
    """
    if total is None:
        total = right.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hubs = right.where(F.col("n") > max(HUB_LEAST, total // HUB_SHARE))
    rest = left.join(F.broadcast(hubs.select(*keys)), keys, "left_anti").join(right.drop("n"), keys)
    return rest.unionByName(left.join(F.broadcast(hubs.drop("n")), keys))


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


@contextmanager
def session_settings(spark: SparkSession, **settings):
    """Settings (``__`` for the dots) for the jobs run inside; the caller's are put back."""
    named = {k.replace("__", "."): v for k, v in settings.items()}
    old = {k: spark.conf.get(k, None) for k in named}
    try:
        for k, v in named.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 1000):
    """Hand Python workers a few megabytes of texts at a time instead of tens, in JVM and worker alike."""
    return session_settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=rows)


def text_size(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and bytes of a text column; sizes every partition count and hash width below."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever number of times the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strings(column) -> list[str]:
    """An Arrow string column as a list, null read as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def chunks(lengths, limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Consecutive slices of rows of about ``limit`` bytes together (one row at least)."""
    begin = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def squeeze(a: np.ndarray) -> bytes:
    """An array as its byte planes, compressed: equal high bytes cost almost nothing."""
    a = np.ascontiguousarray(a)
    head = a.dtype.str.encode().ljust(8)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
    return head + zstandard.ZstdCompressor(level=1).compress(planes)


def unsqueeze(blob: bytes) -> np.ndarray:
    dtype = np.dtype(bytes(blob[:8]).decode().strip())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(blob[8:])), np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, -1).T).view(dtype).reshape(-1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one blob; the first must be sorted and is stored as differences."""
    first = arrays[0]
    parts = [squeeze(np.diff(first, prepend=first.dtype.type(0))), *map(squeeze, arrays[1:])]
    return b"".join([np.array([len(parts), *map(len, parts)], "<u4").tobytes(), *parts])


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    sizes, at, out = np.frombuffer(blob, "<u4", n, 4), 4 + 4 * n, []
    for size in sizes.tolist():
        out.append(unsqueeze(blob[at : at + size]))
        at += size
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def join_packed(blobs) -> list[np.ndarray]:
    """The arrays of many blobs, end to end."""
    return [np.concatenate(x) for x in zip(*map(unpack, blobs), strict=True)]


def by_range(keys: np.ndarray, ranges: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, begin, end) of the equal ranges of ``bits``-wide (at most 56) keys that sorted ``keys`` have any in."""
    scaled = keys if bits <= 32 else keys >> np.uint64(bits - 32)
    r = scaled * np.uint64(ranges) >> np.uint64(min(bits, 32))
    at = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.empty(0, np.int64)
    yield from zip(r[at].tolist(), at.tolist(), np.append(at[1:], len(r)).tolist(), strict=True)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and its inverse's, modulo 2**64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, _BASE), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    up, down = _POWERS[size]
    return up[:n], down[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial hash, one longer than ``buf``; see :func:`span_hash`."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _powers(len(buf))[0], out=out[1:])
    return out


def span_hash(run: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of buf[begin:end] for arrays of bounds: equal strings, equal hashes, wherever they are."""
    return mix((run[end] - run[begin]) * _powers(len(run))[1][begin])


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) of a chunk."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    buf = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = np.concatenate(([False], ~_SPACE[buf], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    return span_hash(prefix_hash(buf), begin, end), np.searchsorted(np.cumsum(sizes), begin, "right")


_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def frame(columns: dict, schema: list[str]) -> pd.DataFrame:
    return pd.DataFrame(columns, columns=schema)
