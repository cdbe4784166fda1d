import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm import media


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 70), st.integers(0, 255))
def test_round_trip(frames, byte):
    payload = bytes((byte + i * 7) % 256 for i in range(frames * media.FRAME))
    data = media.build(payload)
    (track,) = media.tracks(data)
    assert media.samples(data, track) == payload
    at, size = media.keyframes(track)
    assert [data[a : a + s] for a, s in zip(at, size, strict=True)] == [payload[k : k + 192] for k in range(0, len(payload), 192 * 16)]
    assert (track.codec, track.duration, track.timescale, track.width) == ("raw ", frames, 25, 8)
    assert data == media.build(payload)


def test_probe_reads_no_media_data():
    data = media.build(bytes(192 * 40))
    at = data.index(b"mdat") + 4
    assert media._probe(data)["keyframes"] == media._probe(data[:at] + b"\xff" * (len(data) - at))["keyframes"]


def test_uneven_samples_and_all_sync():
    track = media.Track(tables={"stsz": np.array([5, 1, 2, 7]), "stsc": np.array([[1, 1, 1], [2, 2, 1], [3, 1, 1]]), "stco": np.array([[100], [50], [10]])})
    at, size = media.sample_ranges(track)
    assert at.tolist() == [100, 50, 51, 10] and media.keyframes(track)[0].tolist() == at.tolist()


def test_large_and_open_sizes():
    body = media.build(bytes(192))
    kinds = [k for k, _, _ in media.boxes(body)]
    assert kinds == [b"ftyp", b"moov", b"mdat"]
    wide = (1).to_bytes(4, "big") + b"free" + (20).to_bytes(8, "big") + b"abcd"
    assert [k for k, _, _ in media.boxes(wide + body + bytes(4) + b"skip" + b"x" * 9)][0::4] == [b"free", b"skip"]


@pytest.mark.parametrize("cut", [3, 20, 60, 200, 400])
def test_broken_files_say_so(cut):
    out = media._probe(media.build(bytes(192))[:cut])
    assert out["error"] and out["codec"] is None


def test_query_rows(spark):
    texts = [None, "", "a", "é" * 96, "é" * 97, "x" * 100_000, "a"]
    docs = spark.createDataFrame([(i, t, b"z", "q") for i, t in enumerate(texts)], "doc_id long, text string, media binary, feature string")
    got = {r.doc_id: r for r in media.media_round_trip(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (got[i].n_bytes, got[i].payload_bytes) == (len(raw), len(padded))
        assert got[i].payload_sha256 == hashlib.sha256(padded).hexdigest() and got[i].tail_crc32 == zlib.crc32(padded[-16:])
    assert {r.codec for r in got.values()} == {"raw "} and got[5].keyframes[1].begin > got[5].keyframes[0].begin and got[5].duration > got[2].duration > 0
    assert got[2][1:] == got[6][1:] and got[0][1:] == got[1][1:]
    assert media.media_round_trip(docs.limit(0)).collect() == []
    seen = media.probe(spark.createDataFrame([(1, media.build(bytes(192))), (2, None), (3, b"junk")], "k int, media binary")).orderBy("k").collect()
    assert [r.codec for r in seen] == ["raw ", None, None] and seen[0].keyframes[0].size == 192 and seen[2].error
