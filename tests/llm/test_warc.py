import gzip
import hashlib

import pytest

from quantloom.llm import warc


def rows():
    big = "<p>é</p>" * 30
    return [(1, "http://a/?x=%41", big), (9, "http://b/\r\nX: y", big), (5, None, big), (2, "http://c/%0A", None), (3, "u", ""), (4, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", "WARC/1.1\r\n\r\n" * 20), (8, "u", "z" * 2_000_000)]


def want():
    out, first = [], {}
    for i, _, html in sorted(rows(), key=lambda r: r[0]):
        raw = (html or "").encode()
        seen = first.setdefault(raw, i) if len(raw) >= 100 else i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if seen == i else "revisit", None if seen == i else seen))
    return out


@pytest.mark.parametrize("block", [1, 1 << 25])
def test_round_trip(spark, monkeypatch, block):
    monkeypatch.setattr(warc, "BLOCK_BYTES", block)
    pages = spark.createDataFrame([(h, i, u, "c") for i, u, h in rows()], "html string, page_id long, url string, first string").repartition(2)
    got = sorted(map(tuple, warc.warc_round_trip(pages).collect()))
    assert got == want()
    assert warc.warc_round_trip(pages.limit(0)).collect() == []


def test_urls_come_back_and_predicates_are_pushed(spark, tmp_path):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string")
    warc.archive_pages(pages, str(tmp_path))
    df = spark.read.format("warc").load(f"file://{tmp_path}")
    got = {r.record_id: r.target_uri for r in df.select("record_id", "target_uri").collect()}
    assert got == {f"<urn:page:{i}>": u for i, u, _ in rows()}
    one = df.where("record_type = 'revisit' and target_uri is not null")
    assert [r.record_id for r in one.collect()] == ["<urn:page:9>"]
    other = spark.read.format("warc").load(f"file://{tmp_path}").where("record_type = 'response'")
    assert other.count() == 7 and {r.record_type for r in other.select("record_type").collect()} == {"response"}


def test_rejected_payloads_are_not_decoded():
    reader = warc.WarcReader("", ["record_id", "payload"])
    assert [*reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_length",), 3)])] == [warc.EqualTo(("payload_length",), 3)]

    class Data(warc._Bytes):
        kept = 0

        def take(self, n, keep):
            Data.kept += keep
            return super().take(n, keep)

    import io

    body = warc.record({"record_type": "response", "payload": b"abc", "record_id": "1"}) + warc.record({"record_type": "revisit", "record_id": "2"})
    assert [r["record_id"] for r in reader._records(Data(io.BytesIO(gzip.compress(body)), None, True))] == ["2"]
    assert Data.kept == 1


def test_foreign_archives(spark, tmp_path):
    body = warc.record({"record_type": "warcinfo", "record_id": "i", "payload": b"software: x"}) + b"".join(warc.record({"record_type": "response", "record_id": str(k), "payload": b"p" * k}) for k in range(5))
    (tmp_path / "a.warc").write_bytes(body)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(body[:400]) + gzip.compress(body[400:]))
    warc.register(spark)
    got = spark.read.format("warc").load(str(tmp_path)).where("record_type in ('response', 'x')").selectExpr("length(payload) n").collect()
    assert sorted(r.n for r in got) == sorted([*range(5)] * 2)


def test_repeated_rows_stay_as_many(spark):
    big = "<p>x</p>" * 30
    data = [(1, "u", big), (2, "v", big), (2, "v", big), (3, "w", big + "y"), (3, "w", big + "y"), (None, "n", big), (None, "n", None)]
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.warc_round_trip(spark.createDataFrame(data, "page_id long, url string, html string")).collect()), key=str)
    assert got == sorted([(1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None), (3, "response", None), (None, "response", None), (None, "response", None)], key=str)


def test_overwrite_replaces_and_long_headers_are_refused(spark, tmp_path):
    import io

    pages = spark.createDataFrame(rows(), "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.archive_pages(pages, path)
    df = spark.read.format("warc").load(path).where("record_id = '<urn:page:3>'")
    df.write.format("warc").mode("overwrite").save(path)
    assert [r.record_id for r in spark.read.format("warc").load(path).collect()] == ["<urn:page:3>"]
    with pytest.raises(ValueError, match="headers"):
        [*warc.WarcReader("", ["record_id"])._records(warc._Bytes(io.BytesIO(b"WARC/1.1\r\n" + b"x" * (3 << 20)), None, False))]
