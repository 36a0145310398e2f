import hashlib
import io

import pytest
import zstandard

from charlascope.llm import warc
from charlascope.session import run_folder

PAGES = "page_id long, url string, html string, digest int, frame string"


def rows():
    long = "<p>é</p>" * 40
    return [
        (5, "http://a/5", long), (2, "http://a/2", long), (9, None, long), (1, "u", "short"), (3, "u", "short"),
        (4, "x\r\ny", None), (6, "", ""), (None, "n", long), (7, "z", "q" * 99), (8, "z", "q" * 99),
        (10, "z", "q" * 100), (11, "z", "q" * 100), (12, "b", "\r\n\r\nWARC/1.1\r\n" * 30), (13, "v", "w" * 3_000_000),
    ]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(*r, 1, "f") for r in rows()], PAGES).repartition(3)
    out = {(r["page_id"], r["url"]): r for r in warc.archive(pages).collect()}
    assert len(out) == len(rows())
    for page_id, url, html in rows():
        row = out[page_id, " ".join((url or "").splitlines())]
        data = (html or "").encode()
        assert (row["payload_bytes"], row["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        same = [p for p, _, h in rows() if h == html and p is not None]
        first = min(same) if len(data) >= 100 else page_id
        expected = ("response", None) if page_id == first else ("revisit", first)
        assert (row["record_type"], row["refers_to"]) == expected, page_id


def test_repeated_rows_and_no_rows(spark):
    html = "x" * 200
    pages = spark.createDataFrame([(1, "u", html, 1, "f"), (1, "u", html, 1, "f"), (2, "u", html, 1, "f")], PAGES)
    kinds = sorted((r["page_id"], r["record_type"]) for r in warc.archive(pages).collect())
    assert kinds == [(1, "response"), (1, "response"), (2, "revisit")]
    assert warc.archive(pages.limit(0)).count() == 0


def test_record_ids_are_unique_and_lead_to_records(spark):
    html = "x" * 200
    pages = [(1, "u", html), (1, "u", html), (None, "u", html), (None, "u", html), (2, "v", html), (3, "w", "short"), (3, "w", "short")]
    frame = spark.createDataFrame([(*p, 1, "f") for p in pages], PAGES).repartition(3)
    folder = f"{run_folder(spark)}/warc-ids"
    index = warc.write_bundles(frame, folder, date="2025-01-31T12:00:00Z")
    places = {r["record_id"]: r for r in index.collect()}
    assert len(places) == len(pages)
    reader, kinds = warc.BundleReader(folder), []
    for record_id, r in places.items():
        headers, block = warc.parse_record(reader.get(r["bundle"], r["frame"], r["frame_offset"], r["record_bytes"]))
        assert headers["WARC-Record-ID"] == f"<{record_id}>" and headers["WARC-Date"] == "2025-01-31T12:00:00Z"
        kinds.append((r["page_id"] or 0, headers["WARC-Type"]))
        if headers["WARC-Type"] == "revisit":
            target = places[headers["WARC-Refers-To"].strip("<>")]
            assert (target["page_id"], target["digest"], block) == (1, r["digest"], b"")
    assert sorted(kinds) == [
        (0, "revisit"), (0, "revisit"), (1, "response"), (1, "response"), (2, "revisit"), (3, "response"), (3, "response"),
    ]
    one = index.where(f"record_id = '{min(places)}'")
    assert [r["record_id"] for r in warc.read_records(one, folder).collect()] == [min(places)]


def test_one_payload_without_ids_and_nulls_everywhere(spark):
    pages = spark.createDataFrame([(None, None, "y" * 100, None, None)] * 3 + [(None, None, None, None, None)], PAGES)
    out = warc.archive(pages).collect()
    assert sorted((r["record_type"], r["payload_bytes"]) for r in out) == [("response", 0)] + [("response", 100)] * 3


def test_payloads_come_back_and_frames_are_independent(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"{i} " * 9000, 1, "f") for i in range(40)], PAGES).coalesce(1)
    folder = f"{run_folder(spark)}/warc-test"
    monkeypatch.setattr(warc, "FRAME_BYTES", 100_000)
    index = warc.write_bundles(pages, folder)
    assert {r["page_id"]: r["payload"].decode() for r in warc.read_records(index, folder).collect()} == {
        i: f"{i} " * 9000 for i in range(40)
    }
    some = index.where("page_id in (3, 39)")
    assert sorted(r["page_id"] for r in warc.read_records(some, folder).collect()) == [3, 39]


def test_seek_table_is_readable_as_zstandard(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 50)
    writer = warc.BundleWriter(str(tmp_path))
    records = [warc.record({"WARC-Type": "response", "N": str(i)}, b"b" * i) for i in range(9)]
    places = [writer.add(r) for r in records]
    writer.close()
    data = (tmp_path / places[0][0]).read_bytes()
    frames = warc.read_seek_table(io.BytesIO(data), len(data))
    plain = b"".join(
        zstandard.ZstdDecompressor().decompress(data[a : a + n], max_output_size=m) for a, n, m in frames
    )
    assert plain == b"".join(records)
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data) == plain
    reader = warc.BundleReader(str(tmp_path))
    assert [reader.get(*p) for p in places[::-1]] == records[::-1]
    with pytest.raises(ValueError):
        warc.read_seek_table(io.BytesIO(b"0" * 40), 40)
