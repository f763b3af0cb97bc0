"""WARC audit and URL lists, against SQL twins and brute force."""

import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from nearfold.llm import queries, urlfilter, warc
from oracle import assert_same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)


PAGES = "page_id bigint, url string, html string"


def pages(spark, n=9000):
    return spark.createDataFrame([(i, f"https://h{i % 7}.example.com/{i}", f"<p>page {i} é</p>" * (1 + i % 3)) for i in range(n)], PAGES)


def test_audit_finds_exactly_the_differences(spark):
    """A replica indexed from its own records: losses move all later offsets, and are one finding each."""
    left = pages(spark)
    changed, lost, more = {5, 4095, 4113, 8292}, {6, 1000, 8999}, {9001, 20000}
    kept = left.filter(~F.col("page_id").isin(list(lost))).withColumn("html", F.when(F.col("page_id").isin(list(changed)), F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    added = spark.createDataFrame([(i, "https://new.example.com/", "new") for i in more], PAGES)
    a, b = warc.index(left).cache(), warc.index(kept.unionByName(added)).cache()
    got = {r.page_id: r for r in warc.audit(a, b).collect()}
    assert {k: r.finding for k, r in got.items()} == {k: "damaged" for k in changed} | {k: "missing" for k in lost} | {k: "extra" for k in more}
    own = {r.page_id: r for r in a.collect()}
    assert all((got[k].file, got[k].seq, got[k].offset, got[k].length) == (own[k].file, own[k].seq, own[k].offset, own[k].length) for k in changed | lost)
    assert warc.audit(a, a).count() == 0


def test_only_differing_branches_change(spark):
    """One lost record changes one node on each level."""
    rows = pages(spark, 4096)
    a, b = (warc.tree(warc.index(x)).first() for x in (rows, rows.filter("page_id <> 777")))
    changed = []
    for _ in range(warc.LEVELS):
        pairs = [(x, {y.node: y for y in b.nodes}.get(x.node)) for x in a.nodes]
        differ = [(x, y) for x, y in pairs if y is None or x.hash != y.hash]
        changed.append(len(differ))
        a, b = differ[0]
    assert changed == [1] * warc.LEVELS and b is None


def test_bytes_of_warc_files(spark, tmp_path):
    rows = pages(spark, 300)
    raw = {}
    for r in sorted(warc.records(rows).collect(), key=lambda r: r.seq):
        raw.setdefault(r.file, []).append(r.payload.encode())
    (tmp_path / "0.warc").write_bytes(b"".join(raw[0]))
    want = warc.index(rows)
    got = warc.read_warc(spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    (tmp_path / "0.warc").write_bytes(b"".join(raw[0][:40] + [raw[0][41]] + [raw[0][42][:-5] + b"?" + raw[0][42][-4:]] + raw[0][43:]) + b"no record")
    found = {(r.page_id, r.finding) for r in warc.audit(want, warc.read_warc(spark, str(tmp_path))).collect()}
    assert found == {(40, "missing"), (42, "damaged")}
    (tmp_path / "0.warc").unlink()
    (tmp_path / "0.warc.gz").write_bytes(b"".join(map(gzip.compress, raw[0])))
    zipped = {r.page_id: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert len(zipped) == 300 and {(r.page_id, r.digest) for r in want.collect()} == {(k, r.digest) for k, r in zipped.items()}
    for r in zipped.values():
        assert gzip.decompress((tmp_path / "0.warc.gz").read_bytes()[r.offset : r.offset + r.length]) == raw[0][r.seq]


def test_damaged_bytes_are_passed_over():
    one = b"WARC/1.0\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    cut = b"WARC/1.0\r\nContent-Length: 900\r\n\r\nabc"
    assert list(warc.parse(b"")) == [] and list(warc.parse(b"junk")) == []
    assert [(x, n, i) for x, n, i, _ in warc.parse(b"junk" + one + b"junk" + cut)] == [(4, len(one), 7), (8 + len(one), len(cut), None)]
    assert len(list(warc.parse(b"WARC/1.0\r\nno length\r\n\r\n" + one))) == 2
    good = gzip.compress(one)
    assert [i for *_, i, _ in warc.parse(good + b"\x1f\x8b\x08damage" + good)] == [7, None, 7]


def test_records_and_ranges(spark):
    rows = {(r.file, r.seq): r for r in warc.records(pages(spark, 300)).collect()}
    at = 0
    for k in range(300):
        r = rows[0, k]
        raw = r.payload.encode()
        assert r.offset == at and r.length == len(raw)
        head, _, rest = raw.partition(b"\r\n\r\n")
        size = int(head.rsplit(b"Content-Length: ", 1)[1])
        assert rest[size:] == b"\r\n\r\n" and rest[:size].decode().startswith("<p>page")
        at += r.length


def test_warc_awkward(spark):
    rows = [(1, None, None), (1, None, None), (2, "u", ""), (None, "u", "x"), (None, None, None), (-5, "u", "y" * 200000), (2, "u", "other")]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("extra") for c in ("file", "seq", "offset", "digest", "r", "node", "hash", "level", "up")})
    index = warc.index(df)
    assert index.count() == len(rows) and warc.records(df).count() == len(rows)
    assert warc.audit(index, index).count() == 0
    empty = warc.index(spark.createDataFrame([], PAGES))
    assert empty.count() == 0 and warc.audit(empty, empty).count() == 0
    assert {r.finding for r in warc.audit(index, empty).collect()} == {"missing"} and warc.audit(index, empty).count() == len(rows)
    assert warc.records(spark.createDataFrame([], PAGES)).count() == 0


T = lambda day: dt.datetime(2024, 1, day)
CAPTURES = "page_id bigint, url string, fetched_at timestamp"
ENTRIES = "pattern string, action string, at timestamp"


def test_intervals_and_as_of(spark):
    entries = [
        ("d:example.com", "add", T(3)), ("d:example.com", "remove", T(6)), ("d:example.com", "add", T(9)), ("p:a.example.com/x", "add", T(1)), ("u:b.org/y?q=1", "add", T(2)),
        ("d:tie.net", "add", T(4)), ("d:tie.net", "remove", T(4)), ("d:twice.net", "add", T(1)), ("d:twice.net", "add", T(5)), (None, "add", T(1)), ("d:b.org", None, T(1)), ("d:b.org", "add", None), ("d:b.org", "other", T(1)),
    ]
    captures = [
        (1, "http://a.example.com/", T(2)), (2, "http://a.example.com/", T(3)), (3, "http://a.example.com/", T(6)), (4, "https://user@A.Example.com:8080/x/1#f", T(12)), (5, "http://b.org/y?q=1#frag", T(2)), (6, "http://b.org/y", T(2)),
        (14, "  http://example.com.:80/ ", T(4)), (15, "http://[::1]:8080/x", T(9)), (16, "http://u:p@x@a.example.com/x", T(1)),
        (7, "http://tie.net/", T(4)), (8, "http://twice.net", T(7)), (9, None, T(9)), (10, "not a url", T(9)), (11, "http://example.com", None), (12, "http://notexample.com/", T(10)), (None, "http://example.com", T(10)), (2, "http://a.example.com/", T(3)),
    ]
    df = spark.createDataFrame(captures, CAPTURES).withColumns({c: F.lit("extra") for c in ("pattern", "since", "until", "hit", "listed", "at", "rank")})
    got = {r.page_id: (r.listed, r.pattern, r.since) for r in urlfilter.evaluate(df, spark.createDataFrame(entries, ENTRIES)).collect()}
    no = (False, None, None)
    assert got == {
        1: no, 2: (True, "d:example.com", T(3)), 3: no, 4: (True, "p:a.example.com/x", T(1)), 5: (True, "u:b.org/y?q=1", T(2)), 6: no, 7: no, 8: (True, "d:twice.net", T(5)), 9: no, 10: no, 11: no, 12: no, None: (True, "d:example.com", T(9)),
        14: (True, "d:example.com", T(3)), 15: no, 16: (True, "p:a.example.com/x", T(1)),
    }


def test_empty_list_and_large_list(spark, monkeypatch):
    captures = spark.createDataFrame([(1, "http://a.com/", T(2))], CAPTURES)
    none = urlfilter.evaluate(captures, spark.createDataFrame([], ENTRIES)).collect()
    assert [tuple(r) for r in none] == [(1, T(2), False, None, None)]
    assert urlfilter.evaluate(spark.createDataFrame([], CAPTURES), spark.createDataFrame([("d:a.com", "add", T(1))], ENTRIES)).count() == 0
    monkeypatch.setattr(urlfilter, "BROADCAST_BYTES", -1)
    one = urlfilter.evaluate(captures, spark.createDataFrame([("d:a.com", "add", T(1))], ENTRIES))
    assert one.first().listed
