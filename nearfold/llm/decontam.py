"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

Every run of ``WINDOW`` words of an item (the whole item where it is shorter) becomes a pattern of one automaton,
over words of three letters each, so that a pattern has three states a word. Each text is normalised and scanned once;
what the automaton says is confirmed by the words' whole hashes; matches of one item that overlap are
joined, and their offsets are mapped back to the original text.

An automaton has at most ``STATES`` states. Where the items have more, the patterns are first matched by their
hashes, in a join, with those that the documents hold, and only patterns that occur are compiled: still
one automaton and one scan, however large the benchmark. Should even these be more than ``STATES``, they are
split over several automata that each scan the texts.

Defined results: null and empty texts, and texts without words, have no matches; very long texts are scanned
whole; null items, items without an id that is a whole number and items without words give no pattern; repeated
items are all reported; repeated rows are reported each; columns other than those read are ignored; an empty
benchmark matches nothing, and an empty table has no matches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import fresh, keep_keys, materialize
from .textcol import LETTERS, TextBatch, arrow_column, letters, mix, modest_batches, slices

#: Words of a pattern.
WINDOW = 10
#: States of one automaton at most (about 100 bytes each in every worker).
STATES = 2_000_000
_Q = np.uint64(0x9FB21C651E98DF25)

MATCH = "item_id bigint, start int, end int, words int"
_MATCH = pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())])
_BUILT: dict[str, list] = {}
#: Words of a pattern, as hashes, and the items that hold it.
Pattern = tuple[tuple[int, ...], list[int]]


def patterns(items: list[tuple[int, str]], window: int = WINDOW) -> list[Pattern]:
    """The distinct patterns of items."""
    found: dict[tuple[int, ...], set[int]] = {}
    for part, ids in ((pa.array([t]), i) for i, t in items):
        words = TextBatch(part).word_hashes().tolist()
        for k in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[k : k + window]), set()).add(ids)
    return [(w, sorted(ids)) for w, ids in found.items()]


def build(own: list[Pattern]) -> ahocorasick.Automaton:
    """The automaton; the value of a pattern has all (words, items) that are spelled alike in letters."""
    auto = ahocorasick.Automaton()
    for words, ids in own:
        key = letters(np.array(words, np.uint64))
        auto.add_word(key, [*auto.get(key, []), (words, ids)])
    if own:
        auto.make_automaton()
    return auto


def scan(autos: list[ahocorasick.Automaton], column: pa.Array) -> list[list[dict]]:
    """Joined matches of every text of a column."""
    found: list[list[dict]] = []
    for part in slices(column):
        batch = TextBatch(part)
        hashes = batch.word_hashes()
        starts, ends, first = batch.words
        text, size = letters(hashes), len(LETTERS)
        for row in range(batch.n):
            a, b = int(first[row]), int(first[row + 1])
            spans: dict[int, list[list[int]]] = {}
            for auto in autos if b > a else ():
                if not len(auto):
                    continue
                for last, said in auto.iter(text[a * size : b * size]):
                    for words, items in said:
                        hi = a + (last + 1) // size
                        lo = hi - len(words)
                        if tuple(hashes[lo:hi].tolist()) == words:
                            for item in items:
                                spans.setdefault(item, []).append([lo, hi])
            joined = []
            for item, own in sorted(spans.items()):
                own.sort()
                out = [own[0]]
                for lo, hi in own[1:]:
                    if lo < out[-1][1]:
                        out[-1][1] = max(out[-1][1], hi)
                    else:
                        out.append([lo, hi])
                joined += [{"item_id": item, "start": batch.char_at(row, int(starts[lo])), "end": batch.char_at(row, int(ends[hi - 1])), "words": hi - lo} for lo, hi in out]
            found.append(joined)
    return found


def _automata(sent, key: str) -> list[ahocorasick.Automaton]:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = [build(own) for own in sent.value]
    return _BUILT[key]


def _count(text: pa.Array, sent, key: str) -> pa.Array:
    return pa.array([len(x) for x in scan(_automata(sent, key), text)], pa.int32())


def _hits(batches: Iterator[pa.RecordBatch], sent, key: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = scan(_automata(sent, key), b.column("text"))
        rows = [k for k, own in enumerate(found) for _ in own]
        if rows:
            flat = pa.array([x for own in found for x in own], _MATCH)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), *flat.flatten()], ["doc_id", *(f.name for f in _MATCH)])


def _held(batches: Iterator[pa.RecordBatch], window: int, lengths: list[int]) -> Iterator[pa.RecordBatch]:
    """Distinct hashes of the runs of texts, of these lengths."""
    for b in batches:
        for part in slices(b.column("text")):
            batch = TextBatch(part)
            words, first = batch.word_hashes(), batch.words[2]
            left = np.repeat(first[1:], np.diff(first)) - np.arange(len(words))
            run = np.zeros(len(words), np.uint64)
            for n in range(1, window + 1):
                run = run * _Q + words[np.minimum(np.arange(len(words)) + n - 1, max(len(words) - 1, 0))]
                if n in lengths:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(mix(run[left >= n] + np.uint64(n))).view(np.int64))], ["h"])


def _item_patterns(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(h, n, item_id, at) of every pattern of items: hash, words, and where it begins."""
    for b in batches:
        for item, text in zip(b.column("item_id").to_pylist(), b.column("text")):
            words = TextBatch(pa.array([text.as_py()])).word_hashes()
            n = min(len(words), window)
            if n:
                run = np.zeros(len(words) - n + 1, np.uint64)
                for k in range(n):
                    run = run * _Q + words[k : len(words) - n + 1 + k]
                size = len(run)
                grams = np.lib.stride_tricks.sliding_window_view(words, n).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix(run + np.uint64(n)).view(np.int64)), pa.array(np.full(size, n, np.int32)), pa.array(np.full(size, item, np.int64)), pa.array(grams.tolist(), pa.list_(pa.int64()))], ["h", "n", "item_id", "words"]
                )


def _occurring(docs: DataFrame, items: DataFrame, window: int) -> list[list[Pattern]]:
    """The patterns that documents hold, found by a join of hashes, dealt to automata of at most ``STATES`` states."""
    table = materialize(items.mapInArrow(lambda it: _item_patterns(it, window), "h bigint, n int, item_id bigint, words array<bigint>"))
    lengths = [r.n for r in table.select("n").distinct().collect()]
    keys = materialize(table.select("h").distinct())
    held = keep_keys(docs.select("text").filter("text IS NOT NULL").mapInArrow(lambda it: _held(it, window, lengths), "h bigint"), keys, "h").distinct()
    out: list[list[Pattern]] = [[]]
    states = 0
    own = table.join(held, "h", "left_semi").groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    for r in own.toLocalIterator():
        if states + len(LETTERS) * len(r.words) > STATES:
            out.append([])
            states = 0
        states += len(LETTERS) * len(r.words)
        out[-1].append((tuple(x & 0xFFFFFFFFFFFFFFFF for x in r.words), r.ids))
    return out


def _send(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple:
    """The patterns of all automata, for all workers."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").try_cast("bigint").alias("item_id"), F.col("text").alias("text")).filter("text IS NOT NULL AND item_id IS NOT NULL")
    # A word, with what parts it from the next, has at least two characters, and begins one pattern at most.
    bound = items.agg(F.sum(F.length("text") / 2 * window * len(LETTERS))).first()[0] or 0
    own = [patterns([tuple(r) for r in items.collect()], window)] if bound <= 8 * STATES else None
    if own is None or sum(len(w) for w, _ in own[0]) * len(LETTERS) > STATES:
        own = _occurring(docs, items, window)
    return spark.sparkContext.broadcast(own), uuid.uuid4().hex


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each passage of a benchmark item in a document: doc_id, item_id, start, end (characters), words."""
    modest_batches(docs.sparkSession)
    sent, key = _send(docs, benchmark, window)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(MATCH).fields])
    return docs.select("doc_id", "text").mapInArrow(lambda it: _hits(it, sent, key), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, that hold no passage of the benchmark."""
    flag = fresh("__hits", docs.columns)
    count = arrow_column(_count, "int", *_send(docs, benchmark, window))
    return docs.withColumn(flag, count(F.col("text"))).filter(F.col(flag) == 0).drop(flag)
