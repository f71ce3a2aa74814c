import base64
import hashlib
import io

from tessella.llm import queries, store, warc


def brute(pages):
    """pages: {id: html}"""
    keeper = {}
    for i, h in pages.items():
        keeper[h or ""] = max(i, keeper.get(h or "", i))
    out = set()
    for i, h in pages.items():
        raw = (h or "").encode()
        k = keeper[h or ""]
        out.add((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if k == i else "revisit", None if k == i else k))
    return out


def test_query_equals_brute_force(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert {tuple(r) for r in queries.op7_warc(spark, sf).collect()} == brute(pages)


def test_query_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    result = con.execute(queries.ORACLE_SQL["op7_warc"])
    names = [c[0] for c in result.description]
    assert {tuple(r) for r in queries.op7_warc(spark, sf).select(*names).collect()} == set(result.fetchall())


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://a/\r\nX: y", ""), (3, "u", "é" * 70_000), (4, "u", "é" * 70_000), (5, "u", "a\r\n\r\nb"), (7, "u", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {tuple(r) for r in warc.round_trip(df).collect()} == brute({r[0]: r[2] for r in rows})
    assert warc.round_trip(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (0, "u", "a")], "page_id long, url string, html string")
    assert sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in warc.round_trip(twice).collect()) == [(-1, "response", None), (-1, "revisit", 1), (1, "response", None), (1, "response", None)]


def test_payloads_come_back_exactly_and_predicates_are_pushed_down(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "payload %d " % (i % 7) * 50) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for compress in (True, False):
        target = str(tmp_path / f"w{compress}")
        names = warc.write_archives(df, target, compress=compress)
        assert sum(n for _, n in names) == 40
        back = warc.read_archives(spark, target)
        got = {r["target_uri"]: bytes(r["payload"]).decode() for r in back.where("record_type = 'response'").collect()}
        assert got == {f"http://h/{i}": rows[i][2] for i in range(33, 40)}
        one = back.where("target_uri = 'http://h/35' AND record_type IN ('response', 'resource')")
        assert [r["record_id"] for r in one.collect()] == ["<urn:tessella:page:35>"]
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "BatchScan warc" in plan and not [line for line in plan.splitlines() if "Filter" in line and ("http://h/35" in line or "resource" in line)]
        heads = warc.read_archives(spark, target, payload="false").where("record_type = 'response'").collect()
        assert len(heads) == 7 and all(r["payload"] is None and r["payload_digest"] for r in heads)
        assert warc.read_archives(spark, target, partitionBytes="1").where("record_type = 'revisit'").count() == 33


def test_unwanted_members_are_not_inflated():
    bad = bytearray(warc.member(warc.page_record("<a>", "u", b"z" * 100_000, None)))
    bad[-40:-8] = b"\0" * 32  # its end can't be inflated
    good = warc.member(warc.page_record("<b>", "v", b"ok", None))
    raw = io.BytesIO(bytes(bad) + good)
    got = list(warc.read_records(warc._File(raw), lambda h: h["warc-record-id"] == "<b>", True))
    assert len(got) == 1 and got[0][1].endswith(b"\r\n\r\nok")
    raw.seek(0)
    foreign = warc.page_record("<c>", "u", b"q" * 10, None)
    import gzip

    plain = io.BytesIO(gzip.compress(foreign) + gzip.compress(warc.page_record("<d>", "u", b"w" * 200_000, None)))
    assert [b[-1:] for _, b in warc.read_records(warc._File(plain), lambda h: True, True)] == [b"q", b"w"]


def test_long_headers_and_skipping():
    uri = "http://h/" + "".join(hashlib.sha1(str(i).encode()).hexdigest() for i in range(600))
    records = [warc.page_record("<a>", uri, b"x" * 10, None), warc.page_record("<b>", "u", b"y" * 2_000_000, None), warc.page_record("<c>", uri, b"z", None)]
    for dress in (warc.member, bytes):
        raw = b"".join(map(dress, records))
        assert [(h["warc-record-id"], h["warc-target-uri"]) for h, _ in warc.read_records(warc._File(io.BytesIO(raw)), lambda h: True, False)] == [("<a>", uri), ("<b>", "u"), ("<c>", uri)]
        assert [b[-1:] for _, b in warc.read_records(warc._File(io.BytesIO(raw)), lambda h: h["warc-record-id"] != "<b>", True)] == [b"x", b"z"]


def test_clashing_columns_and_frequent_payloads(spark):
    rows = [(i, "u", None if i % 2 else "a", "s", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha string, rank int").repartition(7)
    assert {tuple(r) for r in warc.round_trip(df).collect()} == brute({r[0]: r[2] for r in rows})


def test_scratch_is_below_the_shared_folder(spark):
    assert store.scratch_root(spark).endswith(spark.sparkContext.applicationId)
