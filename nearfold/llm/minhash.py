"""Near-duplicate detection with SetSketch registers.

A document's set is its word ``SHINGLE``-grams. Register i holds K = floor(1 - log_b x) of the smallest
x, over the set, of exponentially distributed hashes of rate ``RATE``, truncated to 0..``TOP``: an
exponentially spaced minimum. Registers of a union are the larger ones (``merge``), so sketches are
mergeable, and equal registers get likelier with similarity, so bands of them are keys for candidates.

Documents with the same words are one node. Nodes that share a band of registers are candidates; the
two sketches' registers give the maximum-likelihood estimate of their Jaccard similarity, jointly with
their sizes; pairs whose estimate comes within ``SLACK`` of the threshold are verified on their exact
shingle sets. Groups are the connected components of verified pairs.

In a band with many nodes, each is first compared with the smallest one, which joins a large group of
copies in as many comparisons as it has members. Then all pairs in the band that the first comparisons
left in different components are compared, so no candidate is skipped that could join two components.

A document here is a distinct pair of doc_id and text, so rows that repeat an id with another text are
compared like all others. Rows carry a hash of their text, computed in the JVM, which tells them apart.

Defined results: null texts are no duplicates of anything, and neither are texts without words; a text
shorter than a shingle is one shingle of all its words; very long texts are sketched whole, slice by slice;
equal rows are one document; rows without a doc_id that is a whole number are ignored by ``duplicates``
and kept by ``drop_duplicates``; a group keeps its smallest doc_id, of texts with that id the first by
hash; other columns are never read; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import doc_key, fresh, keep_keys, materialize, release
from .textcol import TextBatch, mix, modest_batches, segments, shingles, slices

SHINGLE = 3
BANDS, ROWS = 40, 4
THRESHOLD = 0.5
#: Estimates this far below the threshold are still verified (about three standard errors of 160 registers).
SLACK = 0.13
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
SEED = 0x5E7
#: Keys of shared bands (16 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_BANDS = 2_000_000
_LOG_B = float(np.log(BASE))


def _keys(count: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED))
    return x[:count], x[count:] | np.uint64(1)


def registers(hashes: np.ndarray, begin: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """SetSketch registers (rows x count, uint16) of the sets ``hashes[begin[i]:begin[i + 1]]``, none of them empty."""
    flip, odd = _keys(count)
    least = np.empty((len(begin), count), np.uint64)
    for i in range(count):
        least[:, i] = np.minimum.reduceat((hashes ^ flip[i]) * odd[i], begin)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / _LOG_B), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def cardinality(k: np.ndarray) -> np.ndarray:
    """Estimated set sizes from registers."""
    m = k.shape[-1]
    return m * (1 - 1 / BASE) / (RATE * _LOG_B * np.exp(-_LOG_B * k.astype(np.float64)).sum(-1))


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard estimates of pairs of sketches (rows x registers), jointly with their sizes."""
    m = a.shape[1]
    more, less = (a > b).sum(1), (a < b).sum(1)
    n1, n2 = cardinality(a), cardinality(b)
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    lo, hi = np.zeros(len(a)), np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / _LOG_B, 1e-12, 1 - 1e-12)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + (m - more - less) * np.log(np.maximum(1 - up - down, 1e-12))

    for _ in range(30):  # the likelihood is concave
        third = (hi - lo) / 3
        left = likelihood(lo + third) < likelihood(hi - third)
        lo, hi = np.where(left, lo + third, lo), np.where(left, hi, hi - third)
    return (lo + hi) / 2


def _sets(part: pa.Array) -> tuple[TextBatch, np.ndarray, np.ndarray, np.ndarray]:
    batch = TextBatch(part)
    words = batch.word_hashes()
    own, begin = shingles(words, batch.words[2], SHINGLE)
    return batch, words, own, begin


SKETCH = "doc_id bigint, t bigint, h1 bigint, h2 bigint, sketch binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts with words: two hashes of the word sequence, and the registers."""
    for b in batches:
        ids, marks, at = b.column("doc_id"), b.column("t"), 0
        for part in slices(b.column("text")):
            batch, words, own, begin = _sets(part)
            rows, start = segments(begin)
            if len(rows):
                first = batch.words[2]
                place = np.arange(len(words), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
                with np.errstate(over="ignore"):
                    h1 = np.add.reduceat(mix(words + place * np.uint64(0x9E3779B97F4A7C15)), first[:-1][rows])
                    h2 = np.add.reduceat(mix((words ^ np.uint64(0xD1B54A32D192ED03)) + place * np.uint64(0xAEF17502108EF2D9)), first[:-1][rows])
                k = registers(own, start).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows + at)), marks.take(pa.array(rows + at)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array([r.tobytes() for r in k], pa.binary())],
                    ["doc_id", "t", "h1", "h2", "sketch"],
                )
            at += len(part)


def _bands(sketch: pa.Array) -> np.ndarray:
    k = np.frombuffer(b"".join(sketch.to_pylist()), "<u2").reshape(len(sketch), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(k), BANDS)) + np.uint64(1)
    for r in range(ROWS):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + k[:, :, r])
    return key.view(np.int64)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            key = _bands(b.column("sketch"))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(b.column("node").to_numpy(), BANDS))], ["key", "node"])


def _estimate(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(b.num_rows, -1) for c in ("sa", "sb"))
            keep = pa.array(similarity(x, y) >= least)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct shingles as sorted 64-bit numbers."""
    for b in batches:
        ids, marks, at = b.column("doc_id"), b.column("t"), 0
        for part in slices(b.column("text")):
            _, _, own, begin = _sets(part)
            grams = pa.array([np.unique(own[begin[i] : begin[i + 1]]).tobytes() for i in range(len(part))], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), marks.slice(at, len(part)), grams], ["doc_id", "t", "grams"])
            at += len(part)


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("ga").to_pylist(), b.column("gb").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
            keep.append(both >= threshold * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, t, text) of the rows with both, t a hash of the text."""
    return docs.select(doc_key(), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("t"), "text")


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a < b) of nodes whose estimate and then whose exact similarity reach the threshold."""
    left, right = (nodes.select(F.col("node").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
    likely = materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(lambda it: _estimate(it, threshold - SLACK), "a bigint, b bigint"))
    ends = materialize(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct())
    wanted = materialize(keep_keys(nodes.select("node", "doc_id", "t"), ends, "node"))
    texts = keep_keys(rows, wanted.select("doc_id", "t"), ["doc_id", "t"])
    grams = materialize(texts.mapInArrow(_shingle_sets, "doc_id bigint, t bigint, grams binary").join(wanted, ["doc_id", "t"]).select("node", "grams"))
    left, right = (grams.select(F.col("node").alias(c), F.col("grams").alias(f"g{c}")) for c in "ab")
    found = materialize(likely.join(left, "a").join(right, "b").select("a", "b", "ga", "gb").mapInArrow(lambda it: _verify(it, threshold), "a bigint, b bigint"))
    release(likely, ends, wanted, grams)
    return found


def _members(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, t, first, size) of all documents in groups of several; first has the group's first doc_id and t."""
    modest_batches(docs.sparkSession)
    rows = rows_of(docs)
    # Written once, so that the numbers of the rows stay.
    sketches = materialize(rows.mapInArrow(_sketch, SKETCH).withColumn("node", F.monotonically_increasing_id()))
    heads = sketches.groupBy("h1", "h2").agg(F.min("node").alias("head"))
    placed = materialize(sketches.select("node", "doc_id", "t", "h1", "h2").join(heads, ["h1", "h2"]).select("node", "doc_id", "t", "head"))
    nodes = materialize(sketches.join(placed.filter("node = head").select("node"), "node", "left_semi").select("node", "doc_id", "t", "sketch"))
    release(sketches)
    bands = nodes.mapInArrow(_band_rows, "key bigint, node bigint")
    keys = materialize(bands.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1").select("key", "least"))
    several = F.broadcast(keys) if keys.count() <= BROADCAST_BANDS else keys
    shared = materialize(bands.join(several, "key"))
    first = shared.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    edges = _verified(first, nodes, rows, threshold)
    labels = components(edges)
    labelled = shared.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    open_keys = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    rest = materialize(labelled.join(open_keys, "key", "left_semi"))
    x, y = rest.select("key", F.col("node").alias("a"), F.col("c").alias("ca")), rest.select("key", F.col("node").alias("b"), F.col("c").alias("cb"))
    second = materialize(x.join(y, "key").filter("a < b AND ca <> cb").select("a", "b").distinct().join(first, ["a", "b"], "left_anti"))
    if not second.isEmpty():
        more = _verified(second, nodes, rows, threshold)
        labels = components(edges.unionByName(more))
        release(more)
    release(keys, shared, rest, second, nodes, edges)
    grouped = placed.join(labels.withColumnRenamed("node", "head"), "head", "left").select("doc_id", "t", F.coalesce("component", "head").alias("group")).distinct()
    size = grouped.groupBy("group").agg(F.count("*").alias("size"), F.min(F.struct("doc_id", "t")).alias("first")).filter("size > 1")
    return grouped.join(size, "group").select("doc_id", "t", "first", "size")


def duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document that its group doesn't keep: doc_id, duplicate_of (the one kept), group_size."""
    found = _members(docs, threshold).select("doc_id", F.col("first.doc_id").alias("duplicate_of"), F.col("size").alias("group_size"))
    return found.filter("doc_id <> duplicate_of").distinct()


def drop_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, without those that their groups don't keep; of equal rows one stays."""
    found = _members(docs, threshold)
    key, mark = fresh("__key", docs.columns), fresh("__mark", docs.columns)
    gone = materialize(found.filter("first.doc_id <> doc_id OR first.t <> t").select(F.col("doc_id").alias(key), F.col("t").alias(mark)))
    marked = docs.withColumns({key: doc_key(), mark: F.xxhash64("text")})
    kept = keep_keys(marked, gone, [key, mark], "left_anti")
    again = materialize(marked.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").select(key))
    if again.isEmpty():
        return kept.select(docs.columns)
    single, several = (keep_keys(kept, again, key, how) for how in ("left_anti", "left_semi"))
    return single.select(docs.columns).unionByName(several.dropDuplicates([key, mark]).select(docs.columns))
