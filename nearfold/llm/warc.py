"""WARC records and a Merkle fixity audit of two replicas of them.

``records`` lays pages out as WARC/1.0 records and ``read_warc`` finds the records in the bytes of WARC files.
``index`` gives each record's file, number, ordered range of offsets and digest. ``FILE_RECORDS`` consecutive page ids
make a file, and an id's place among them is its slot.

``tree`` hashes the records of every slot with their lengths, in order, then ``FANOUT`` neighbouring slots at a time with
the bytes that each spans, up to one root for each file, which so commits to all ranges. Ranges count from the
beginning of their node, and nodes are cut by id: a record that is lost changes the hashes above it and no others,
although all later offsets move. ``audit`` compares the roots of two replicas, each indexed from its own records,
and descends only below nodes that differ. In the slots it arrives at, records are aligned by id
and digest; what is left over is damaged, missing or extra.

Defined results: null urls and pages are empty ones; records without an id belong to file -1, with a slot by
their digest; pages that repeat an id are records of their own, ordered by content; very long pages are hashed whole;
other columns are never read; replicas without records, or with equal ones, give no findings; a file that one replica
lacks is reported record by record.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import keep_keys, materialize, release

FAN_BITS = 4
LEVELS = 3
FANOUT = 1 << FAN_BITS
FILE_RECORDS = 1 << (FAN_BITS * LEVELS)
INDEX = ("file", "slot", "seq", "page_id", "offset", "length", "digest")


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as the bytes of a WARC response record."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def _placed(records: DataFrame) -> DataFrame:
    """With file and slot, from page_id and digest."""
    bits = FAN_BITS * LEVELS
    file = F.coalesce(F.shiftright("page_id", bits), F.lit(-1).cast("bigint"))
    slot = F.coalesce(F.col("page_id").bitwiseAND(F.lit(FILE_RECORDS - 1).cast("bigint")), F.conv(F.substring("digest", 1, bits // 4), 16, 10).cast("bigint"))
    return records.withColumns({"file": file, "slot": slot.cast("int")})


def index(pages: DataFrame) -> DataFrame:
    """(file, slot, seq, page_id, offset, length, digest) of the records of pages; their bytes stay where they are read."""
    page = F.col("page_id").try_cast("bigint")
    made = pages.select(page.alias("page_id"), record(page, F.col("url"), F.col("html")).alias("r"))
    hashed = _placed(made.select("page_id", F.octet_length("r").cast("bigint").alias("length"), F.sha2("r", 256).alias("digest")))
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return hashed.select("file", "slot", (F.row_number().over(order) - 1).cast("bigint").alias("seq"), "page_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint").alias("offset"), "length", "digest")


def records(pages: DataFrame) -> DataFrame:
    """(file, seq, page_id, url, offset, length, payload): every page as a record at its place in a file."""
    page = F.col("page_id").try_cast("bigint")
    placed = index(pages).select("file", "seq", "offset", "length", "digest", "page_id")
    full = pages.select(page.alias("page_id"), "url", record(page, F.col("url"), F.col("html")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    same = Window.partitionBy("page_id", "digest").orderBy(F.lit(0))
    nth = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("seq"))
    joined = placed.withColumn("nth", nth).alias("p").join(full.withColumn("nth", F.row_number().over(same)).alias("f"), F.col("p.page_id").eqNullSafe(F.col("f.page_id")) & (F.col("p.digest") == F.col("f.digest")) & (F.col("p.nth") == F.col("f.nth")))
    return joined.select("p.file", "p.seq", "p.page_id", "f.url", "p.offset", "p.length", "f.payload")


_START = re.compile(rb"WARC/\d\.\d\r?\n")
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)")
_ID = re.compile(rb"(?im)^warc-record-id:[ \t]*<urn:page:(-?\d{1,18})>")


def parse(data: bytes) -> Iterator[tuple[int, int, int | None, str]]:
    """(offset, length, page id, SHA-256) of the records in the bytes of a WARC file.

    Files of gzip members, one for each record, have the ranges of the members and the digests of what they hold. Bytes
    between records that begin none are passed over; a record that the file cuts short ends with it.
    """
    at = 0
    if data[:2] == b"\x1f\x8b":
        while at < len(data):
            unzip = zlib.decompressobj(31)
            try:
                raw = unzip.decompress(data[at:]) if at == 0 else unzip.decompress(memoryview(data)[at:])
            except zlib.error:
                raw = b""
            size = len(data) - at - len(unzip.unused_data) if raw and unzip.eof else 0
            if not size:  # damaged: on to the next member
                following = data.find(b"\x1f\x8b\x08", at + 1)
                size = (following if following > 0 else len(data)) - at
            m = _ID.search(raw.partition(b"\r\n\r\n")[0])
            yield at, size, int(m[1]) if m else None, hashlib.sha256(raw).hexdigest()
            at += size
        return
    while start := _START.search(data, at):
        at = start.start()
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end] if end >= 0 else data[at:]
        body, name = _LENGTH.search(head), _ID.search(head)
        stop = min(len(data), end + 4 + int(body[1])) if end >= 0 and body else at + len(head)
        if data[stop : stop + 4] == b"\r\n\r\n":
            stop += 4
        yield at, stop - at, int(name[1]) if name else None, hashlib.sha256(data[at:stop]).hexdigest()
        at = stop


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column("content"):
            rows = list(parse(content.as_buffer().to_pybytes()))
            if rows:
                offset, length, page, digest = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(page, pa.int64()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(digest)], ["seq", "page_id", "offset", "length", "digest"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The index of the records in WARC files, plain or gzip; one task holds one file of at most 2 GB at a time.

    Records of other programs, whose ids aren't those of pages, belong to file -1.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("content")
    return _placed(files.mapInArrow(_parsed, "seq bigint, page_id bigint, offset bigint, length bigint, digest string")).select(*INDEX)


def tree(replica: DataFrame) -> DataFrame:
    """(file, root, nodes): one row for each file, with its nodes nested: (node, hash, bytes, nodes below), in order."""
    parts = int(replica.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = F.array_sort(F.collect_list(F.struct("seq", "page_id", "length", "digest")))
    text = F.array_join(F.transform("held", lambda x: F.concat_ws(":", F.coalesce(x["page_id"].cast("string"), F.lit("-")), x["length"], x["digest"])), "|")
    leaves = replica.repartition(parts, "file").groupBy("file", "slot").agg(held.alias("held"), F.sum("length").alias("bytes"))
    level = leaves.select("file", F.col("slot").alias("node"), F.sha2(F.concat(F.lit("0|"), text), 256).alias("hash"), "bytes")
    for k in range(LEVELS):
        parent = F.shiftright("node", FAN_BITS) if k < LEVELS - 1 else F.lit(0)
        below = [c for c in level.columns if c != "file"]
        up = level.groupBy("file", parent.alias("up")).agg(F.array_sort(F.collect_list(F.struct(*below))).alias("nodes"), F.sum("bytes").alias("bytes"))
        text = F.array_join(F.transform("nodes", lambda x: F.concat_ws(":", x["node"], x["bytes"], x["hash"])), "|")
        level = up.select("file", F.col("up").alias("node"), F.sha2(F.concat(F.lit("1|"), text), 256).alias("hash"), "bytes", "nodes")
    return level.select("file", F.col("hash").alias("root"), "nodes")


def _differing(a: Column, b: Column) -> Column:
    """(node, a, b) of the nodes of two lists whose hashes differ, or that one of them lacks."""
    a, b = (F.coalesce(x, F.array()) for x in (a, b))
    names = F.array_distinct(F.concat(F.transform(a, lambda x: x["node"]), F.transform(b, lambda x: x["node"])))
    pairs = F.transform(names, lambda n: F.struct(n.alias("node"), F.get(F.filter(a, lambda x: x["node"] == n), F.lit(0)).alias("a"), F.get(F.filter(b, lambda x: x["node"] == n), F.lit(0)).alias("b")))
    return F.filter(pairs, lambda p: ~p["a"]["hash"].eqNullSafe(p["b"]["hash"]))


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, seq, page_id, offset, length, finding) of records in which the replicas differ.

    Both have the columns of ``index``. ``finding`` is damaged, missing (only in ``left``) or extra (only in
    ``right``); number and range are those of ``left`` where it has the record.
    """
    a, b = (materialize(tree(r)) for r in (left, right))
    roots = a.select("file", F.col("root").alias("ra")).join(b.select("file", F.col("root").alias("rb")), "file", "full")
    files = materialize(roots.filter(~F.col("ra").eqNullSafe(F.col("rb"))).select("file"))
    below = keep_keys(a.select("file", F.col("nodes").alias("a")), files, "file").join(keep_keys(b.select("file", F.col("nodes").alias("b")), files, "file"), "file", "full")
    for k in range(LEVELS):
        pair = F.explode(_differing(F.col("a"), F.col("b"))).alias("p")
        below = below.select("file", pair).select("file", "p.node", *((F.col(f"p.{c}.nodes").alias(c) for c in "ab") if k < LEVELS - 1 else ()))
    at = materialize(below.select("file", F.col("node").alias("slot")).distinct())
    release(a, b, files)
    sides = (keep_keys(r, at, ["file", "slot"]).select("file", "page_id", "digest", "length", "seq", "offset", F.lit(k).alias("side")) for k, r in enumerate((left, right)))
    both = next(sides).unionByName(next(sides))
    same = ["file", "page_id", "digest", "length"]
    place = F.struct("seq", "offset", "length")
    own = lambda k: F.max(F.when(F.col("side") == k, F.col("place")))
    numbered = both.withColumn("nth", F.row_number().over(Window.partitionBy(*same, "side").orderBy("seq")))
    alone = numbered.groupBy(*same, "nth").agg(F.count("*").alias("n"), F.first("side").alias("side"), F.first(place).alias("place")).filter("n = 1")
    pairs = alone.withColumn("nth", F.row_number().over(Window.partitionBy("file", "page_id", "side").orderBy("place")))
    found = pairs.groupBy("file", "page_id", "nth").agg(own(0).alias("x"), own(1).alias("y"))
    kind = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("damaged")
    at = F.coalesce("x", "y")
    return found.select("file", at["seq"].alias("seq"), "page_id", at["offset"].alias("offset"), at["length"].alias("length"), kind.alias("finding"))
