import pytest

from stratagraph.llm import warc


def arc(version, records):
    out = warc.version_block(version, "x.arc")
    for url, body in records:
        out += warc.arc_line(version, len(out), "x.arc", url, "20010203040506", "text/html", len(body)) + body + b"\n"
    return out


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_by_declared_length(version):
    bodies = [b"HTTP/1.0 200 OK\r\nX-Page-Id: 7\r\n\r\nhi\nhttp://fake 0.0.0.0 1 text/html 9\n", b"", b"\n\nplain\r\n\r\n"]
    data = arc(version, [("http://a/b c", bodies[0]), ("dns:x", bodies[1]), ("http://y", bodies[2])])
    got = list(warc.read_arc(data + arc(3 - version, [("http://z", b"q")])))
    assert [r.body for r in got] == [*bodies, b"q"] and got[0].fields["URL"] == "http://a/b c"
    rows = list(warc.converted(1, data))
    assert [(r[0], r[2], r[3]) for r in rows] == [(7, "response", "2001-02-03T04:05:06Z"), (None, "resource", "2001-02-03T04:05:06Z"), (None, "resource", "2001-02-03T04:05:06Z")]
    assert len({r[1] for r in rows}) == 3 and rows[1][8] == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_bad_arcs_fail():
    with pytest.raises(ValueError, match="of 5 bytes"):
        list(warc.read_arc(warc.version_block(1, "x") + warc.arc_line(1, 0, "x", "http://a", "20010101000000", "t/h", 5) + b"abc"))
    with pytest.raises(ValueError, match="version block"):
        list(warc.read_arc(b"http://a 0.0.0.0 20010101000000 t/h 0\n\n"))


def test_round_trip_with_nulls_ties_and_long_texts(spark, tmp_path):
    long = "<p>ü\r\n\r\nWARC/1.0\r\n</p>" * 50_000
    rows = [(5, "http://a", "x"), (3, "http://b\n", "x"), (None, None, None), (9, "u", ""), (9, "u", ""), (None, "v", "x"), (11, "l", long), (12, "l", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    pages.withColumnRenamed("x", "y").write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op6_arc_to_warc(spark, str(tmp_path)).collect()
    said = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str)
    n = len(long.encode())
    want = [(3, 1, "response", None), (5, 1, "revisit", 3), (None, 1, "revisit", 3), (11, n, "response", None), (12, n, "revisit", 11)]
    empty = [(9, 0, "response", None), (9, 0, "revisit", 9), (None, 0, "revisit", 9)]
    assert said == sorted(want + empty, key=str)
    assert {r.payload_digest for r in got if r.payload_bytes == 1} == {warc.digest(b"x")}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op6_arc_to_warc(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_files_by_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 3)
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i % 4}</p>", "x") for i in range(10)], "page_id long, url string, html string, arc string").coalesce(1)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    rows = {r.page_id: r for r in warc.op6_arc_to_warc(spark, str(tmp_path)).collect()}
    assert len(rows) == 10 and [rows[i].refers_to for i in range(10)] == [None, None, None, None, 0, 1, 2, 3, 0, 1]
