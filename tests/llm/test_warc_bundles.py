"""Bundles: round trips, frames read alone, the seek table, deduplication by brute force, and messy rows."""

import hashlib
import io
import os

import pyarrow.fs as pafs
import pytest
import zstandard

from corpusloom.llm import warc_bundles as W

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, p in payloads:
        same = [j for j, q in payloads if q == p and j is not None] if len(p) >= 100 else []
        first = min(same) if same and min(same) != i else None
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if first is None else "revisit", first))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()),
                  key=str)


LONG = "<p>ünï" * 200_000
ROWS = [(i, f"http://h/{i}", f"<html>{'word ' * 30}{i % 7}</html>") for i in range(60)] + [
    (100, None, None), (101, "http://x/\r\nWARC-Type: evil", ""), (102, "u", "short"), (103, "u", "short"),
    (104, "u", LONG), (99, "u", LONG), (None, "u", LONG), (105, "u", "x" * 99), (106, "u", "x" * 99),
    (107, "u", "y" * 100), (107, "u", "y" * 100), (108, "u", "y" * 100), (None, None, "z" * 200), (None, None, "z" * 200),
    (109, "u", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 10)]


def test_against_brute_force_and_payloads_back(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'c' AS digest", "1 AS first", "2 AS frame", "3 AS least").repartition(3)
    path = f"file://{tmp_path}/warc"
    index = W.write_bundles(pages, path, frame_bytes=2000, bundle_bytes=300)
    back = W.read_bundles(index, path, with_payload=True).cache()
    assert got(back) == brute(ROWS)
    assert all(r["intact"] for r in back.where("record_type = 'response'").collect())
    html = {i: (h or "").encode() for i, _, h in ROWS if i is not None}
    assert all(bytes(r["payload"]) == html[r["page_id"]] for r in back.where("payload is not null and page_id is not null").collect())
    assert back.where("page_id = 101").first()["url"] == "http://x/%0D%0AWARC-Type: evil"
    # each index row leads to its record
    rows = index.collect()
    assert len({r["bundle"] for r in rows}) > 3
    fs = pafs.LocalFileSystem()
    for r in rows:
        reader = W.BundleReader(fs.open_input_file(f"{tmp_path}/warc/bundles/{r['bundle']}"))
        data = reader.frame(r["frame"])[r["offset"]:r["offset"] + r["length"]]
        (_, fields, _), = W.records_in(data)
        assert (fields["WARC-Record-ID"], fields["WARC-Type"]) == (r["record_id"], r["record_type"])


def test_fetch_reads_revisits_through_their_response(spark, tmp_path):
    path = f"file://{tmp_path}/warc"
    index = W.write_bundles(spark.createDataFrame(ROWS, SCHEMA), path, frame_bytes=2000)
    wanted = [0, 8, 53, 100, 104, 12345]
    found = {r["page_id"]: bytes(r["payload"]) for r in W.fetch(index, path, spark.createDataFrame([(i,) for i in wanted], "page_id long")).collect()}
    html = {i: (h or "").encode() for i, _, h in ROWS}
    assert found == {i: html[i] for i in wanted[:-1]}


class _Counting:
    """A file that counts the bytes read."""

    def __init__(self, data):
        self.f, self.n, self.read_bytes = io.BytesIO(data), len(data), 0

    def size(self):
        return self.n

    def seek(self, at):
        self.f.seek(at)

    def read(self, n):
        self.read_bytes += n
        return self.f.read(n)


def test_one_frame_is_read_alone_and_any_reader_reads_the_whole(tmp_path):
    out = io.BytesIO()
    out.close, keep = lambda: None, [os.urandom(900) for _ in range(50)]
    writer = W.BundleWriter(out, frame_bytes=2000)
    places = [writer.add(k) for k in keep]
    writer.close()
    file = _Counting(out.getvalue())
    reader = W.BundleReader(file)
    before = file.read_bytes
    frame, offset = places[31]
    assert reader.frame(frame)[offset:offset + 900] == keep[31] and file.read_bytes - before < 2200
    assert places[0] == (0, 0) and places[2] == (1, 0)
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert plain == b"".join(keep)
    with pytest.raises(ValueError):
        W.BundleReader(_Counting(b"x" * 100))


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "warc")
    pages = spark.createDataFrame([], SCHEMA)
    index = W.write_bundles(pages, path)
    assert index.collect() == [] and W.read_bundles(index, path).collect() == []
    assert W.archived_pages(spark, pages).collect() == []
