import gzip
import hashlib
import random

from cubegraph.llm import warc as w

BIG = "<p>" + "é" * 200 + "</p>"
ROWS = [
    (3, "http://a/1", BIG), (1, "http://a/2", BIG), (2, "http://b/\r\nX: y", BIG), (4, None, "short"), (5, "http://b/3", "short"),
    (6, "http://c", None), (7, "http://c", ""), (None, "http://d", BIG), (8, "http://e", "x\r\n\r\nWARC/1.1\r\n\r\n" * 5000), (1, "http://a/2", BIG),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string" if rows and len(rows[0]) == 4 else "page_id long, url string, html string")


def expected():
    out = []
    for page_id, _, html in ROWS:
        data = (html or "").encode()
        same = [i for i, _, h in ROWS if (h or "").encode() == data and i is not None]
        first = min(same, default=None) if len(data) >= 100 else page_id
        revisit = len(data) >= 100 and page_id != first
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    w.archived(frame(spark), path)
    assert sorted((tuple(r) for r in w.pages_of(spark, path).collect()), key=repr) == expected()
    urls = {r["record_id"]: r["target_uri"] for r in spark.read.format("warc").option("path", path).load().collect()}
    assert urls["urn:page:4"] is None and urls["urn:page:2"] == "http://b/%0D%0AX: y"
    payloads = {r["record_id"]: bytes(r["payload"]).decode() for r in spark.read.format("warc").option("path", path).load().filter("record_type = 'response'").collect()}
    assert payloads["urn:page:8"] == ROWS[8][2] and payloads["urn:page:1"] == BIG
    for f in (tmp_path / "archive").glob("*.warc.gz"):
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_appends_add_and_overwrites_replace(spark, tmp_path):
    path = str(tmp_path / "archive")
    ids = lambda: sorted(r["record_id"] for r in spark.read.format("warc").option("path", path).load().select("record_id").collect())
    w.archived(frame(spark, ROWS[3:5]), path)
    w.archived(frame(spark, ROWS[5:7]), path)
    assert ids() == [f"urn:page:{i}" for i in (4, 5, 6, 7)]
    rows = spark.read.format("warc").option("path", path).load().filter("record_id = 'urn:page:4'").cache()
    rows.count()
    rows.write.format("warc").option("path", path).mode("overwrite").save()
    assert ids() == ["urn:page:4"]
    assert len(list((tmp_path / "archive").glob("_manifest-*.json"))) == 1


def test_predicates_skip_records_and_payloads(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "archive")
    w.archived(frame(spark), path)
    reader = w.WarcReader(path, payloads=False)
    keep = w.EqualTo(("record_type",), "revisit")
    other = w.GreaterThan(("payload_length",), 3) if hasattr(w, "GreaterThan") else w.EqualTo(("payload_length",), 3)
    assert list(reader.pushFilters([keep, other])) == [other]
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert rows and all(r["record_type"] == "revisit" and r["payload"] is None for r in rows)


def test_foreign_archives(spark, tmp_path):
    rows = [{"record_type": "response", "record_id": f"urn:page:{i}", "target_uri": "http://x", "date": None, "refers_to": None, "payload_digest": None, "payload_length": None, "payload": (b"%d" % i) * 3000} for i in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(w.record(r)) for r in rows))
    (tmp_path / "b.warc").write_bytes(b"".join(w.record(r) for r in rows))
    w.use(spark)
    got = spark.read.format("warc").option("path", str(tmp_path)).load()
    assert got.count() == 10
    assert {bytes(r["payload"]) for r in got.filter("record_id = 'urn:page:3'").collect()} == {b"3" * 3000}


def test_lost_attempts_are_not_read(spark, tmp_path):
    path = str(tmp_path / "archive")
    w.archived(frame(spark), path)
    (tmp_path / "archive" / "lost.warc.gz").write_bytes(w.member(w.record({"record_type": "response", "record_id": "urn:page:99", "payload": b"", "payload_length": 0})))
    assert 99 not in {r["page_id"] for r in w.pages_of(spark, path).collect()}


def test_clashing_columns_and_empty_table(spark):
    from pyspark.sql import functions as F

    df = frame(spark).select("*", *[F.lit("x").alias(c) for c in ("digest", "size", "first", "payload", "record_type")])
    assert sorted((tuple(r) for r in w.through_archives(df).collect()), key=repr) == expected()
    assert w.through_archives(frame(spark).limit(0)).collect() == []


def test_records_at_every_place_of_the_readers_buffer(tmp_path):
    """A record may begin where one or a few bytes of the buffer are left."""
    fields = {"record_type": "response", "payload_length": None}
    for left in (1, 2, 5, 23, 24):
        size, body = (1 << 18) - left, random.Random(left).randbytes(1 << 18)
        least = len(w.member(w.record({**fields, "record_id": "urn:page:1", "payload": body}))) - len(body)
        cut = size - least
        while (made := w.member(w.record({**fields, "record_id": "urn:page:1", "payload": body[:cut]}))) and len(made) != size:
            cut += size - len(made)
        rest = [w.member(w.record({**fields, "record_id": f"urn:page:{i}", "payload": b"x" * i})) for i in range(2, 40)]
        (tmp_path / "a.warc.gz").write_bytes(made + b"".join(rest))
        for payloads in (True, False):  # without payloads the reader passes over them
            source = w.Source(*w.open_fs(str(tmp_path / "a.warc.gz")), 0, None)
            found = list(w.records(source, lambda r: True, payloads))
            assert [r["record_id"] for r in found] == [f"urn:page:{i}" for i in range(1, 40)], left
            assert [r["payload"] for r in found[1:]] == [b"x" * i if payloads else None for i in range(2, 40)]
