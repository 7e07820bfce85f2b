"""WARC archives: exact round trips, revisits, predicates and partitions."""

import gzip
import hashlib
import os

import pyarrow as pa
import pytest

from strandloom.llm import warc

BIG = "<p>" + "é" * 80 + "</p>"


def pages(spark):
    rows = [(4, "http://a/\r\nX-Bad: 1", BIG), (2, None, BIG), (9, "http://c", BIG), (9, "http://c", BIG), (None, "http://n", BIG), (5, "http://d", "short"), (6, "http://e", "short"), (7, "http://f", None), (8, "http://g", "a\r\n\r\nWARC/1.1\r\n" * 20)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, tmp_path, compression):
    path = str(tmp_path / "a")
    warc.write(warc.as_records(pages(spark)), path, compression=compression, fileBytes=400)
    rows = warc.read(spark, path, partitionBytes=500).collect()
    assert len(rows) == 9
    full = {4: BIG, 2: BIG, 9: BIG, None: BIG, 5: "short", 6: "short", 7: "", 8: "a\r\n\r\nWARC/1.1\r\n" * 20}
    for r in rows:
        data = full[r.page_id].encode()
        assert r.payload_bytes == len(data) and r.payload_digest == "sha256:" + hashlib.sha256(data).hexdigest()
        revisit = r.page_id in (4, 9, None)
        assert (r.record_type, r.refers_to) == (("revisit", 2) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == data
    assert {r.target_uri for r in rows if r.page_id == 4} == {"http://a/  X-Bad: 1"} or {r.target_uri for r in rows if r.page_id == 4} == {"http://a/ X-Bad: 1"}


def test_predicates_reach_the_reader(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write(warc.as_records(pages(spark)), path)
    read = warc.read(spark, path)
    assert sorted(r.page_id for r in read.where("record_type = 'response' AND page_id IN (2, 5, 9)").collect()) == [2, 5]
    assert read.where("record_type = 'warcinfo'").count() == 0
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("page_id",), (2, 5)), GreaterThan(("page_id",), 1)]))
    assert len(left) == 1 and isinstance(left[0], GreaterThan)
    found = [row for p in reader.partitions() for b in reader.read(p) for row in b.to_pylist()]
    assert sorted(r["page_id"] for r in found) == [2, 5]


def test_payloads_are_skipped_unless_asked_for(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write(warc.as_records(pages(spark)), path)
    assert warc.read(spark, path, payload="false").where("payload IS NOT NULL").count() == 0


def test_files_without_a_commit_are_not_read(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write(warc.as_records(pages(spark)), path)
    (tmp_path / "a" / "lost.warc").write_bytes(b"WARC/1.1\r\nhalf")
    assert warc.read(spark, path).count() == 9
    for name in os.listdir(tmp_path / "a"):
        if name.startswith(warc.MANIFEST):
            os.remove(tmp_path / "a" / name)
    os.remove(tmp_path / "a" / "lost.warc")
    assert warc.read(spark, path).count() == 9


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "e")
    warc.write(warc.as_records(pages(spark).where("false")), path)
    assert warc.read(spark, path).count() == 0


def raw(path, gz=False):
    """Header dictionaries of the records in a folder, by a plain reader of its own."""
    found = []
    for name in sorted(os.listdir(path)):
        if name.endswith((".warc", ".warc.gz")):
            data = (path / name).read_bytes()
            data = gzip.decompress(data) if name.endswith(".gz") else data
            while data:
                head, _, rest = data.partition(b"\r\n\r\n")
                headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                found.append(headers)
                assert rest[int(headers["Content-Length"]) :][:4] == b"\r\n\r\n"
                data = rest[int(headers["Content-Length"]) + 4 :]
    return found


def test_each_reference_meets_a_record_id_and_ids_stay(spark, tmp_path):
    for name in ("a", "b"):
        warc.write(warc.as_records(pages(spark)), str(tmp_path / name), compression="gzip")
    a, b = raw(tmp_path / "a"), raw(tmp_path / "b")
    ids = [h["WARC-Record-ID"] for h in a]
    assert sorted(ids) == sorted(h["WARC-Record-ID"] for h in b)
    refers = [h["WARC-Refers-To"] for h in a if h["WARC-Type"] == "revisit"]
    responses = {h["WARC-Record-ID"] for h in a if h["WARC-Type"] == "response"}
    assert len(refers) == 4 and set(refers) <= responses
    assert len(set(ids)) == len({(h["WARC-Type"], h.get("X-Page-ID"), h["WARC-Payload-Digest"]) for h in a}) == 8


def test_appends_add_and_overwrites_replace(spark, tmp_path):
    path = str(tmp_path / "a")
    two = [warc.WarcWriter({"path": path}, False) for _ in range(2)]
    for k, writer in enumerate(two):
        written = writer.write(iter([pa.RecordBatch.from_pylist([{"record_type": "resource", "page_id": k, "payload": b"x"}])]))
        writer.files = written
    for writer in two:
        writer.commit([writer.files])
    assert sorted(r.page_id for r in warc.read(spark, path).collect()) == [0, 1]
    over = warc.WarcWriter({"path": path}, True)
    over.commit([over.write(iter([pa.RecordBatch.from_pylist([{"record_type": "resource", "page_id": 7, "payload": b"y"}])]))])
    assert [(r.page_id, bytes(r.payload)) for r in warc.read(spark, path).collect()] == [(7, b"y")]


def made(kind, block, *lines, length=None, end=b"\r\n\r\n"):
    head = ["WARC/1.1", f"WARC-Type: {kind}", *lines, *([] if length == "" else [f"Content-Length: {len(block) if length is None else length}"])]
    return "\r\n".join(head).encode("latin-1") + b"\r\n\r\n" + block + end


def test_foreign_and_malformed_archives(spark, tmp_path):
    good = made("resource", b"fine")
    http = "Content-Type: application/http"
    cases = {
        "types": (b"".join(made(k, b"abc") for k in ("conversion", "metadata", "request", "warcinfo")), [(k, None, b"abc") for k in ("conversion", "metadata", "request", "warcinfo")]),
        "http": (made("response", b"HTTP/1.1 200 OK\r\nA: b", http) + made("request", b"GET / HTTP/1.1\r\n\r\nbody", http) + good, [("response", "HTTP headers without an end", b"HTTP/1.1 200 OK\r\nA: b"), ("request", None, b"body"), ("resource", None, b"fine")]),
        "length": (made("response", b"lost", length="") + good + made("response", b"lost", length="x") + good, [("response", "no Content-Length", None), ("resource", None, b"fine")] * 2),
        "latin": (made("resource", b"data", "WARC-Target-URI: http://\xe9") + good, [("resource", None, b"data"), ("resource", None, b"fine")]),
        "short": (good + made("resource", b"cut", length=100, end=b""), [("resource", None, b"fine"), ("resource", "record ends early", b"cut")]),
        "long": (made("resource", b"longer than said", length=4) + good, [("resource", "no empty lines after the record", b"long"), ("resource", None, b"fine")]),
        "noise": (b"noise\r\nmore\r\n" + good + b"\r\n\r\n" + good, [(None, "not a record", None), ("resource", None, b"fine"), ("resource", None, b"fine")]),
        "head": (good + b"WARC/1.1\r\nWARC-Type: resp", [("resource", None, b"fine"), ("resp", "record ends early", None)]),
        "empty": (b"", []),
    }
    for name, (data, want) in cases.items():
        for gz in (False, True):
            path = tmp_path / f"{name}.warc{'.gz' * gz}"
            path.write_bytes(gzip.compress(data) if gz else data)
            rows = warc.read(spark, str(path)).collect()
            assert [(r.record_type, r.problem, r.payload and bytes(r.payload)) for r in rows] == want, (name, gz)
    path = tmp_path / "half.warc.gz"
    path.write_bytes(gzip.compress(good) + gzip.compress(made("resource", os.urandom(5000)))[:2000])
    rows = warc.read(spark, str(path)).collect()
    assert [r.record_type for r in rows] == ["resource", "resource"] and rows[1].problem == "record ends early" and 1000 < len(rows[1].payload) < 5000
    assert warc.read(spark, str(path), payload="false").count() == 2


def test_hot_payloads_and_long_ones(spark, tmp_path):
    rows = [(None if i == 9 else i, f"http://{i}", BIG if i % 3 else f"{BIG}{i}") for i in range(900)] + [(5000, "http://long", "é" * 2_000_000), (5001, "http://long", "é" * 2_000_000)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write(warc.as_records(docs), str(tmp_path / "a"), compression="gzip")
    back = warc.read(spark, str(tmp_path / "a")).collect()
    assert len(back) == len(rows)
    for r in back:
        if r.page_id == 5001:
            assert r.refers_to == 5000
        elif r.page_id is not None and r.page_id < 900:
            assert (r.record_type, r.refers_to) == (("revisit", 1) if r.page_id % 3 and r.page_id != 1 else ("response", None))
    assert next(r for r in back if r.page_id == 5000).payload_bytes == 4_000_000
