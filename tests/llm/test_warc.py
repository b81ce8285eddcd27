import hashlib

from larder.llm import warc

PAGES = [
    (4, "http://a/1", "x" * 120),
    (2, "http://a/2", "x" * 120),
    (2, "http://a/2", "x" * 120),
    (9, None, "x" * 120),
    (None, "http://a/ n\r\nl", "x" * 120),
    (5, "http://a/3", "short"),
    (6, "http://a/4", "short"),
    (7, "http://a/5", None),
    (8, "", ""),
    (-3, "http://a/6", "é\r\n\r\n" * 5000),
    (10, "http://a/7", "é\r\n\r\n" * 5000),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "z", "z") for r in rows], "page_id long, url string, html string, offset string, file string")


def expected(rows):
    first, out, seen = {}, [], set()
    for i, _, html in rows:
        if len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, (True, 0)), (i is None, i or 0))
    for i, _, html in rows:
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        revisit = html in first and ((i is None, i or 0) != first[html] or (i, html) in seen)
        seen.add((i, html))
        out.append((i, len(data), digest, "revisit" if revisit else "response", first[html][1] if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    folder = str(tmp_path / "archive")
    index = warc.write_archive(frame(spark).repartition(3), folder)
    records = warc.read_records(index, folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records), key=repr) == expected(PAGES)
    html = {(i, h or "") for i, _, h in PAGES}
    for r in records:
        if r.record_type == "response":
            assert (r.page_id, bytes(r.payload).decode()) in html
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest
        else:
            assert r.payload is None
    places = sorted((r.file, r.offset, r.length) for r in index.collect())
    for (f, o, n), (g, p, _) in zip(places, places[1:], strict=False):
        assert f != g or o + n == p


def test_reads_only_what_the_index_rows_name(spark, tmp_path):
    folder = str(tmp_path / "archive")
    warc.write_archive(frame(spark), folder)
    some = warc.read_index(spark, folder).where("page_id in (5, 10)")
    assert {r.page_id for r in warc.read_records(some, folder).collect()} == {5, 10}


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path / "archive")
    index = warc.write_archive(frame(spark).where("false"), folder)
    assert index.count() == 0 and warc.read_records(index, folder).count() == 0


def test_record_ids():
    for i in (0, 1, -1, 1 << 62, -(1 << 63), None):
        assert warc.page_of(warc.record_id(i)) == i
