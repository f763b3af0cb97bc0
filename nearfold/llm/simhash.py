"""SimHash fingerprints, all pairs of them within a Hamming radius, and the classes that the pairs make.

A document's terms are its words. Every term's 64-bit hash votes for or against each bit with the term's weight; bits
with a positive sum are set. A term weighs (1 + ln c) log2(1 + min(N / d, COMMON)), in 16ths, where it stands c times in the
document and in d of the N documents with words: of all documents, not of a sample. So repeated words say more, and
words of more than one document in ``COMMON``, which unlike texts share, say less; only those are sent to the executors. One changed
word moves few votes, so that near copies that are not equal word for word stay within ``RADIUS`` bits; the README gives the
measured recall. ``weighted=False`` gives every distinct word the same vote, which needs no other documents.

Search: the 64 bits are cut into ``BLOCKS`` blocks, each with a limit of its own; the limits add up to
RADIUS - BLOCKS + 1. Two fingerprints that differ by more than its limit in every block differ by more than
RADIUS bits, so looking every fingerprint up in every block with all flips of up to that block's limit of bits
finds every pair: the result is exact. A pair is taken from the first block that finds it. Fingerprints are
dealt into groups of at most ``GROUP``, and every two groups are one task. Only distinct fingerprints are
searched.

``near`` gives the pairs, whose number can grow with the square of the documents. ``classes`` finds the same pairs but keeps of each what
grows with the documents: how many links a fingerprint has, and a spanning forest of the links of every task, whose
connected components are the classes. So two documents within ``RADIUS`` bits, or joined by a chain of such, have the same class.

Defined results: null texts and texts without words have no fingerprint; a text of one word has one
term; the order of words has no influence; a bit whose votes cancel is 0; documents that share a fingerprint are paired, at distance 0, with
the smallest doc_id among them, which stands for all in the other pairs; rows without a doc_id that is a whole number have
fingerprints but no pairs; rows that repeat a doc_id and its text count once, with another text they have a fingerprint of
their own; ``classes`` has a row for each document, rows without fingerprint being a class of their own with no links; very long texts vote whole; other columns are not read; an empty table gives no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import doc_key, materialize, release
from .textcol import TextBatch, modest_batches, shingles, slices

TERM_WORDS = 1
RADIUS = 11
BLOCKS = 4
#: Terms in at most one of so many documents all weigh alike.
COMMON = 32
#: Distinct fingerprints of a group at most, and below which they are not dealt out.
GROUP = 1 << 21
SMALL_GROUP = 20_000
_CHUNK = 1 << 15
_PAIRS = 1 << 20
_LINKS = 1 << 21  # links of a task that are held at once
_KEY_BITS = 20


def _counted(batch: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of every text, text by text: the text, the term's hash, how often it stands there."""
    terms, begin = shingles(batch.word_hashes(), batch.words[2], TERM_WORDS)
    owner = np.repeat(np.arange(batch.n, dtype=np.uint16 if batch.n < 1 << 16 else np.int64), np.diff(begin))
    by = np.argsort(terms)
    by = by[np.argsort(owner[by], kind="stable")]
    terms, owner = terms[by], owner[by].astype(np.int64)
    fresh = np.ones(len(terms), bool)
    fresh[1:] = (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    return owner[first], terms[first], np.diff(np.append(first, len(terms)))


def _weights(terms: np.ndarray, counts: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whole numbers, so that sums don't depend on the order; ``common``: terms that many documents hold, ascending, and N / d."""
    named, spread = common
    share = np.full(len(terms), float(COMMON))
    if len(named):
        at = np.minimum(np.searchsorted(named, terms), len(named) - 1)
        share = np.where(named[at] == terms, spread[at], share)
    return np.rint(16 * (1 + np.log(counts)) * np.log2(1 + share)).astype(np.int32)


def fingerprints_of(part: pa.Array, common: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a slice that have words, and their fingerprints (uint64); without ``common`` all distinct words weigh alike."""
    batch = TextBatch(part)
    owner, hashes, counts = _counted(batch)
    rows = np.unique(owner)
    if not len(rows):
        return rows, np.zeros(0, np.uint64)
    weights = np.ones(len(hashes), np.int32) if common is None else _weights(hashes, counts, common)
    votes = np.zeros((batch.n, 64), np.int64)
    for a in range(0, len(hashes), _CHUNK):
        h, o, w = (x[a : a + _CHUNK] for x in (hashes, owner, weights))
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        signed = (bits.astype(np.int32) * 2 - 1) * w[:, None]
        start = np.concatenate(([0], np.flatnonzero(o[1:] != o[:-1]) + 1))
        votes[o[start]] += np.add.reduceat(signed, start, axis=0)
    out = np.packbits(votes[rows] > 0, axis=1).view(">u8").ravel().astype(np.uint64)
    return rows, out


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in slices(b.column("text")):
            owner, terms, _ = _counted(TextBatch(part))
            found, n = np.unique(terms, return_counts=True)
            named = pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(found.view(np.int64))])  # null: the texts with words
            yield pa.RecordBatch.from_arrays([named, pa.array(np.append(len(np.unique(owner)), n).astype(np.int64))], ["term", "texts"])


def common_terms(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The terms (uint64, ascending) of more than one in ``COMMON`` of all documents with words, and N / d of each: at most
    ``COMMON`` times the distinct words of a mean document."""
    modest_batches(docs.sparkSession)
    rows = docs.select("text").mapInArrow(_term_rows, "term bigint, texts bigint")
    seen = materialize(rows.groupBy("term").agg(F.sum("texts").alias("texts")))
    whole = seen.filter("term IS NULL").first()
    whole = whole.texts if whole else 0
    kept = seen.filter(F.col("term").isNotNull() & (F.col("texts") * COMMON > whole)).toArrow()
    release(seen)
    terms, texts = kept["term"].to_numpy().view(np.uint64), kept["texts"].to_numpy()
    by = np.argsort(terms)
    return terms[by], whole / texts[by]


def _fingerprint_rows(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    common = sent and sent.value
    for b in batches:
        at = 0
        for part in slices(b.column("text")):
            rows, prints = fingerprints_of(part, common)
            own, none = np.zeros(len(part), np.int64), np.ones(len(part), bool)
            own[rows], none[rows] = prints.view(np.int64), False
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(part)), pa.array(own, mask=none)], ["doc_id", "fingerprint"])
            at += len(part)


def all_fingerprints(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """doc_id, fingerprint of every document, null of those without words."""
    modest_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(common_terms(docs)) if weighted else None
    return docs.select(doc_key(), "text").mapInArrow(lambda it: _fingerprint_rows(it, sent), "doc_id bigint, fingerprint bigint")


def fingerprints(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """doc_id, fingerprint of every document with words."""
    return all_fingerprints(docs, weighted).filter("fingerprint IS NOT NULL")


def blocks_of(radius: int = RADIUS, blocks: int = BLOCKS) -> list[tuple[int, int, int]]:
    """First bit, width and limit of the blocks that are looked up."""
    if not (0 <= radius <= 64 and 1 <= blocks <= 64):
        raise ValueError("need 0 <= radius <= 64 and 1 <= blocks <= 64")
    edge = [64 * k // blocks for k in range(blocks + 1)]
    limit = [(radius + 1 + blocks - 1 - k) // blocks - 1 for k in range(blocks)]
    return [(a, min(b - a, _KEY_BITS), t) for a, b, t in zip(edge, edge[1:], limit) if t >= 0]


def _runs_within(a: np.ndarray, b: np.ndarray, radius: int, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j), a run of them at a time, with ``a[i]`` and ``b[j]`` (uint64) within the radius."""
    cut = blocks_of(radius, blocks)
    for k, (at, width, limit) in enumerate(cut):
        low = np.uint64((1 << width) - 1)
        ka, kb = ((x >> np.uint64(at) & low).astype(np.int64) for x in (a, b))
        oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
        sa, sb, ka = a[oa], b[ob], ka[oa]
        first = np.concatenate(([0], np.cumsum(np.bincount(kb, minlength=1 << width))))
        for flips in (f for t in range(min(limit, width) + 1) for f in combinations(range(width), t)):
            key = ka ^ sum(1 << f for f in flips)
            start = first[key]
            count = first[key + 1] - start
            total = np.concatenate(([0], np.cumsum(count)))
            i = 0
            while i < len(sa):
                j = max(i + 1, int(np.searchsorted(total, total[i] + _PAIRS, "right")) - 1)
                n = count[i:j]
                left = np.repeat(np.arange(i, j), n)
                right = np.arange(total[i], total[j]) + np.repeat(start[i:j] - total[i:j], n)
                differ = sa[left] ^ sb[right]
                ok = np.flatnonzero(np.bitwise_count(differ) <= radius)
                differ, left, right = differ[ok], left[ok], right[ok]
                fresh = np.ones(len(ok), bool)
                for at_, width_, limit_ in cut[:k]:
                    fresh &= np.bitwise_count(differ >> np.uint64(at_) & np.uint64((1 << width_) - 1)) > limit_
                if fresh.any():
                    yield oa[left[fresh]], ob[right[fresh]]
                i = j


def pairs_within(a: np.ndarray, b: np.ndarray, radius: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with ``a[i]`` and ``b[j]`` (uint64) within the radius."""
    found = list(_runs_within(a, b, radius, blocks))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _cell(radius: int, blocks: int) -> Callable[[pa.Table], pa.Table]:
    def pairs(t: pa.Table) -> pa.Table:
        own, low, high, doc, prints = (t.column(c).to_numpy() for c in ("own", "low", "high", "doc", "fingerprint"))
        prints = prints.view(np.uint64)
        x, y = np.flatnonzero(own == low), np.flatnonzero(own == high)
        i, j = pairs_within(prints[x], prints[y], radius, blocks)
        i, j = x[i], y[j]
        if len(own) and low[0] == high[0]:
            i, j = i[i < j], j[i < j]
        a, b = doc[i], doc[j]
        return pa.table({"doc_a": np.minimum(a, b), "doc_b": np.maximum(a, b), "distance": np.bitwise_count(prints[i] ^ prints[j]).astype(np.int32)})

    return pairs


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` (the smallest node of each node's tree) after the links (i, j)."""
    while True:
        i, j = root[i], root[j]
        apart = i != j
        if not apart.any():
            return root
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
        while (root[root] != root).any():
            root = root[root]


def _forest(radius: int, blocks: int) -> Callable[[pa.Table], pa.Table]:
    def forest(t: pa.Table) -> pa.Table:
        own, low, high, docs, prints = (t.column(c).to_numpy() for c in ("own", "low", "high", "docs", "fingerprint"))
        keys = prints.view(np.uint64)
        x, y = np.flatnonzero(own == low), np.flatnonzero(own == high)
        links, root = np.zeros(len(own), np.int64), np.arange(len(own))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def settle() -> None:
            nonlocal root
            i, j = (np.concatenate(z) for z in zip(*held))
            np.add.at(links, i, docs[j])
            np.add.at(links, j, docs[i])
            root = _join(root, i, j)
            held.clear()

        for i, j in _runs_within(keys[x], keys[y], radius, blocks):
            i, j = x[i], y[j]
            if low[0] == high[0]:
                i, j = i[i < j], j[i < j]
            held.append((i, j))
            if sum(len(i) for i, _ in held) >= _LINKS:
                settle()
        if held:
            settle()
        kept = np.flatnonzero(links)
        return pa.table({"fingerprint": prints[kept], "links": links[kept], "root": prints[root[kept]]})

    return forest


def _dealt(one: DataFrame) -> tuple[DataFrame, int]:
    """Distinct fingerprints copied to every two groups that their own is one of, and the number of such twos."""
    n = one.count()
    groups = max(-(-n // GROUP), min(4, -(-n // SMALL_GROUP)), 1)
    dealt = one.withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.lit(groups)).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other")
    return dealt, groups * (groups + 1) // 2


def near(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_a, doc_b, distance) for all fingerprints within the radius; doc_a < doc_b."""
    blocks_of(radius, blocks)
    prints = prints.filter("doc_id IS NOT NULL")
    one = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc")))
    dealt, tasks = _dealt(one)
    apart = dealt.repartition(tasks, "low", "high").groupBy("low", "high").applyInArrow(_cell(radius, blocks), "doc_a bigint, doc_b bigint, distance int")
    shared = prints.join(one, "fingerprint").filter("doc_id <> doc").select(F.col("doc").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(0).alias("distance")).distinct()
    return apart.unionByName(shared)


def near_documents(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, weighted: bool = False) -> DataFrame:
    return near(materialize(fingerprints(docs, weighted)), radius, blocks)


def classes(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """One row for each doc_id and fingerprint: doc_id, copy_of (the smallest doc_id with its fingerprint), class_id (the smallest doc_id
    that a chain of links leads to, its own if none does), links (other rows within the radius, copies among them)."""
    blocks_of(radius, blocks)
    rows = materialize(prints.filter("doc_id IS NOT NULL").distinct())
    one = materialize(rows.filter("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("doc"), F.count("*").alias("docs")))
    dealt, tasks = _dealt(one)
    cells = dealt.repartition(tasks, "low", "high").groupBy("low", "high").applyInArrow(_forest(radius, blocks), "fingerprint bigint, links bigint, root bigint")
    cells = materialize(cells)
    links = cells.groupBy("fingerprint").agg(F.sum("links").alias("links"))
    joined = components(cells.select(F.col("fingerprint").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "fingerprint")
    team = F.coalesce("component", "fingerprint").alias("team")
    placed = materialize(one.join(links, "fingerprint", "left").join(joined, "fingerprint", "left").select("fingerprint", "doc", (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("links"), team))
    release(cells, one)
    named = placed.join(placed.groupBy("team").agg(F.min("doc").alias("class")), "team").select("fingerprint", "doc", "class", "links")
    found = rows.join(named, "fingerprint", "left")
    return found.select("doc_id", F.coalesce("doc", "doc_id").alias("copy_of"), F.coalesce("class", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def document_classes(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, weighted: bool = False) -> DataFrame:
    return classes(all_fingerprints(docs, weighted), radius, blocks)
