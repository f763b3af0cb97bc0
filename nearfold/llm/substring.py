"""Repeated passages: recurring phrases, sharded Aho-Corasick automata, windows confirmed over documents.

A passage is repeated where every run of ``WINDOW`` words in it occurs in at least two documents.

1. Phrases: from each distinct document those runs of ``PHRASE`` words whose smallest 3-word hash comes
   first or last in them. That depends on their words alone, so a phrase is chosen in every document
   that holds it; and any ``WINDOW`` words hold at least one. Phrases of at least two documents recur.
2. Automata: all documents are dealt to shards. A shard's automaton, over words of three letters each, is compiled from
   all recurring phrases of its documents, at most about ``SHARD_PHRASES``, and every document of the shard is
   streamed through it, whether it holds a phrase or not, which locates every occurrence. A phrase of many documents is in
   the automata of many shards, so none is hot, and each document is streamed once however many there are.
3. Confirmation: the ``WINDOW``-word runs around the occurrences are counted over documents; those of
   two or more are repeated, and their union gives the spans.

Documents with the same words are searched once; if they have ``WINDOW`` words, they are repeated whole.

Defined results: case and punctuation don't count (see ``textcol``); null, empty and shorter texts have
no spans; a passage repeated within one document only isn't reported; equal rows are one document, and rows that
repeat a doc_id with another text are documents of their own, whose spans all carry that id; rows without a
doc_id that is a whole number are left out; very long texts are streamed whole; other columns are never read;
an empty table gives no spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import rows_of
from .store import keep_keys, materialize, release
from .textcol import LETTERS, TextBatch, letters, mix, modest_batches, segments, slices

WINDOW = 50
PHRASE = 25
PART = 3
#: Phrases of one automaton, about, and bytes of text of one shard (one text may exceed either).
SHARD_PHRASES = 20_000
SHARD_BYTES = 8 << 20
_Q = np.uint64(0xC6A4A7935BD1E995)
_Q_INV = np.uint64(pow(int(_Q), -1, 1 << 64))


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one array (texts aren't kept apart)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = np.full(len(words), _Q, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    inverse = np.full(n, _Q_INV, np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power)))
    return mix((total[k:] - total[:-k]) * inverse)


def phrases(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the chosen phrases begin (word numbers in the batch, ascending), and their hashes."""
    width = PHRASE - PART + 1
    small = runs(words, PART)
    if len(small) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low, have = small, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    low = np.minimum(low[: len(small) - width + 1], low[width - have : width - have + len(small) - width + 1])
    n = len(low)
    chosen = np.flatnonzero((small[:n] == low) | (small[width - 1 : width - 1 + n] == low))
    end = first[1:][np.searchsorted(first, chosen, "right") - 1]
    chosen = chosen[chosen + PHRASE <= end]
    return chosen, runs(words, PHRASE)[chosen]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of at least ``WINDOW`` words: two hashes of their words, and the chosen phrases' hashes."""
    for b in batches:
        ids, marks, at = b.column("doc_id"), b.column("t"), 0
        for part in slices(b.column("text")):
            batch = TextBatch(part)
            words, first = batch.word_hashes(), batch.words[2]
            rows, start = segments(first)
            if len(rows):
                place = np.arange(len(words), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
                h1 = np.add.reduceat(mix(words + place * np.uint64(0x9E3779B97F4A7C15)), start)
                h2 = np.add.reduceat(mix((words ^ np.uint64(0xD1B54A32D192ED03)) + place * np.uint64(0xAEF17502108EF2D9)), start)
                chosen, hashes = phrases(words, first)
                cut = np.searchsorted(chosen, first)
                long = np.diff(first)[rows] >= WINDOW
                keep = rows[long]
                own = [hashes[cut[r] : cut[r + 1]].view(np.int64) for r in keep.tolist()]
                where = pa.array(keep + at)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(where), marks.take(where), pa.array(h1[long].view(np.int64)), pa.array(h2[long].view(np.int64)), pa.array([np.unique(x) for x in own], pa.list_(pa.int64()))],
                    ["doc_id", "t", "h1", "h2", "phrases"],
                )
            at += len(part)


class Shard:
    """Texts with the hashes of their recurring phrases; one automaton of the phrases, then all texts through it."""

    def __init__(self) -> None:
        self.nodes: list[int | None] = []
        self.words: list[np.ndarray] = []
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)

    def add(self, part: pa.Array, nodes: list[int | None], wanted: list[list[int] | None]) -> None:
        batch = TextBatch(part)
        words, first = batch.word_hashes(), batch.words[2]
        chosen, hashes = phrases(words, first)
        cut = np.searchsorted(chosen, first)
        text = letters(words)
        for row, own in enumerate(wanted):
            self.nodes.append(nodes[row])
            self.words.append(words[first[row] : first[row + 1]])
            if own:
                mine = slice(cut[row], cut[row + 1])
                for w in chosen[mine][np.isin(hashes[mine].view(np.int64), own)].tolist():
                    self.auto.add_word(text[w * len(LETTERS) : (w + PHRASE) * len(LETTERS)])

    def search(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each text with occurrences: its node, begins of the windows around them, and the windows' hashes."""
        if not len(self.auto):
            return
        self.auto.make_automaton()
        for node, words in zip(self.nodes, self.words):
            n = len(words)
            ends = [e for e, _ in self.auto.iter(letters(words))]
            if node is None or not ends or n < WINDOW:
                continue
            last = np.array(ends) // len(LETTERS)  # the last word of each occurrence
            around = np.zeros(n + 2, np.int64)
            np.add.at(around, np.maximum(last + 1 - WINDOW, 0), 1)
            np.add.at(around, last - PHRASE + 2, -1)
            at = np.flatnonzero(np.cumsum(around)[: n - WINDOW + 1] > 0)
            if len(at):
                yield node, at, runs(words, WINDOW)[at]


def _windows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The texts of a task in shards, one after the other. Texts without a node have an equal one elsewhere."""

    def found(shard: Shard) -> Iterator[pa.RecordBatch]:
        for node, begins, hashes in shard.search():
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.full(len(begins), node, np.int64)), pa.array(begins.astype(np.int32))], ["h", "node", "at"])

    shard, size = Shard(), 0
    for b in batches:
        nodes, wanted, at = b.column("node").to_pylist(), b.column("phrases").to_pylist(), 0
        for part in slices(b.column("text")):
            shard.add(part, nodes[at : at + len(part)], wanted[at : at + len(part)])
            size += part.nbytes
            at += len(part)
            if len(shard.auto) >= most or size >= SHARD_BYTES:
                yield from found(shard)
                shard, size = Shard(), 0
    yield from found(shard)


SPANS = "doc_id bigint, start int, end int, words int"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Character spans from texts and the begins of their repeated windows (null: the whole text)."""
    for b in batches:
        rows, at = [], 0
        for part in slices(b.column("text")):
            batch = TextBatch(part)
            starts, ends, first = batch.words
            for row in range(batch.n):
                begins, doc = b.column("begins")[at + row].as_py(), b.column("doc_id")[at + row].as_py()
                n, base = int(first[row + 1] - first[row]), int(first[row])
                if begins is None:
                    joined = [(0, n)]
                else:
                    x = np.unique(np.array(begins, np.int64))
                    cut = np.flatnonzero(np.diff(x) > WINDOW) + 1
                    joined = [(int(p[0]), int(p[-1]) + WINDOW) for p in np.split(x, cut)]
                rows += [(doc, batch.char_at(row, int(starts[base + lo])), batch.char_at(row, int(ends[base + hi - 1])), hi - lo) for lo, hi in joined]
            at += len(part)
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[1:])], ["doc_id", "start", "end", "words"])


def repeated_passages(docs: DataFrame, shard_phrases: int = SHARD_PHRASES) -> DataFrame:
    """One row for each repeated passage of a document: doc_id, start, end (characters), words."""
    modest_batches(docs.sparkSession)
    rows = rows_of(docs)
    # Written once, so that the numbers of the rows stay.
    parsed = materialize(rows.mapInArrow(_distinct, "doc_id bigint, t bigint, h1 bigint, h2 bigint, phrases array<bigint>").withColumn("node", F.monotonically_increasing_id()))
    mark = F.struct("doc_id", "t")
    heads = parsed.groupBy("h1", "h2").agg(F.min("node").alias("head"), (F.min(mark) != F.max(mark)).alias("several"))
    placed = materialize(parsed.select("node", "doc_id", "t", "h1", "h2").join(heads, ["h1", "h2"]).select("node", "doc_id", "t", "head", "several"))
    heads = placed.filter("node = head").select("node", "doc_id", "t")
    held = materialize(parsed.select("node", F.explode("phrases").alias("h")).join(heads.select("node"), "node", "left_semi"))
    release(parsed)
    ends = lambda x: x.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("h")
    own = held.join(ends(held), "h", "left_semi").groupBy("node").agg(F.collect_list("h").alias("phrases"))
    wanted = materialize(heads.join(own, "node", "left"))
    release(held)
    streamed = rows.join(wanted, ["doc_id", "t"], "left").select("node", "phrases", "text")
    windows = materialize(streamed.mapInArrow(lambda it: _windows(it, shard_phrases), "h bigint, node bigint, at int"))
    found = windows.join(ends(windows), "h", "left_semi").groupBy("node").agg(F.collect_set("at").alias("begins"))
    spans = placed.join(found.withColumnRenamed("node", "head"), "head", "left").filter("begins IS NOT NULL OR several")
    spans = materialize(spans.select("doc_id", "t", F.when(~F.col("several"), F.col("begins")).alias("begins")).dropDuplicates(["doc_id", "t"]))
    release(placed, wanted, windows)
    texts = keep_keys(rows, spans.select("doc_id", "t"), ["doc_id", "t"]).dropDuplicates(["doc_id", "t"])
    return texts.join(spans, ["doc_id", "t"]).select("doc_id", "begins", "text").mapInArrow(_spans, SPANS)
