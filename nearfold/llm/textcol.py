"""Whole Arrow string columns as byte arrays: folding, words and word hashes without a loop over rows.

A word is a run of letters, marks and digits of any script; in scripts that are written without blanks
(``ALONE``) every such character is a word of its own. Everything else parts words. Folding lowers the
letters of all scripts whose small form takes as many bytes. Null texts count as empty ones.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch where the session has Spark's defaults: 10,000 whole documents would be hundreds of MB, and blocks of tokens 64 MB in each worker.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def modest_batches(spark: SparkSession | None) -> None:
    """Lower the session's Arrow batch sizes, of rows and bytes, from Spark's defaults; sizes that the user chose stay."""
    if spark is not None and spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    if spark is not None and spark.conf.get(_BYTES, None) is None:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def arrow_column(fn: Callable, kind: str, *args):
    """A column function of one string column: ``fn(pa.Array, *args) -> pa.Array`` run on Arrow batches.

    ``fn`` is a top-level function, so that workers import it and its module's caches live as long as they do.
    """

    modest_batches(SparkSession.getActiveSession())

    def column(text: pa.Array) -> pa.Array:
        return fn(text, *args)

    return F.arrow_udf(column, kind)


WORD, LETTER, OWN = 1, 2, 4
#: First and last code points of scripts without blanks between words: Thai to Myanmar, Khmer, kana, Han.
ALONE = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
_FLAG = {"L": WORD | LETTER, "M": WORD, "N": WORD}
#: Flags and small forms of the code points below 0x800, and of all of them once a text needs them.
_KNOWN: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _code_points(below: int) -> tuple[np.ndarray, np.ndarray]:
    if below not in _KNOWN:
        flags = np.fromiter((_FLAG.get(unicodedata.category(chr(c))[0], 0) for c in range(below)), np.uint8, below)
        for first, last in ALONE:
            own = flags[first : last + 1]
            own[own > 0] |= OWN
        small = np.arange(below, dtype=np.uint32)
        for c in range(below):
            if flags[c] & LETTER and not 0xD800 <= c < 0xE000:
                low = chr(c).lower()
                if len(low) == 1 and low != chr(c) and len(low.encode()) == len(chr(c).encode()):
                    small[c] = ord(low)
        _KNOWN[below] = flags, small
    return _KNOWN[below]


_ASCII_FLAGS = np.zeros(256, np.uint8)
_ASCII_FLAGS[:128] = _code_points(0x800)[0][:128]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_P, _P_INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = 1 << 22) -> np.ndarray:
    """64-bit hash of every ``data[starts[i]:ends[i]]``; starts ascend and ranges don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        power, inverse = _powers(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * power[: b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Cut a column into runs of rows of at most ``limit`` bytes of text (one row may exceed it)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    i, done = 0, 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield column.slice(i, j - i)
        i, done = j, int(sizes[j - 1])


class TextBatch:
    """A run of texts as one byte array in which every text ends with an added line feed."""

    def __init__(self, column: pa.Array):
        column = pc.binary_join_element_wise(pc.fill_null(column.cast(pa.large_string()), ""), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
        self.n = n = len(column)
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if n else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self._words = None
        self._folded = None
        self._flags = None
        self._counted: tuple[int, np.ndarray | None] = (-1, None)

    def _classify(self) -> None:
        d = self.data
        flags, folded = _ASCII_FLAGS[d], _FOLD[d]
        lead = np.flatnonzero(d >= 0xC0)
        if len(lead):
            head = d[lead]
            for low, high, more, mask in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0x100, 3, 0x07)):
                at = lead[(head >= low) & (head < high)]
                if not len(at):
                    continue
                cp = d[at].astype(np.uint32) & mask
                for k in range(1, more + 1):
                    cp = (cp << np.uint32(6)) | (d[at + k] & 0x3F)
                known, small = _code_points(0x800 if more == 1 else 0x110000)
                kind, to = known[cp], small[cp]
                for k in range(more + 1):
                    flags[at + k] = kind
                change = np.flatnonzero(to != cp)
                if len(change):
                    x, to = at[change], to[change]
                    for k in range(more, 0, -1):
                        folded[x + k] = 0x80 | (to & 0x3F)
                        to = to >> np.uint32(6)
                    folded[x] = (d[x] & np.uint8(0xFF ^ mask)) | to.astype(np.uint8)
        self._flags, self._folded = flags, folded

    @property
    def flags(self) -> np.ndarray:
        """Of every byte, whether its character is WORD, LETTER, OWN."""
        if self._flags is None:
            self._classify()
        return self._flags

    @property
    def folded(self) -> np.ndarray:
        if self._folded is None:
            self._classify()
        return self._folded

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words in the byte array, and the first word of every text (n + 1 entries)."""
        if self._words is None:
            flags = self.flags
            m = np.zeros(len(flags) + 1, np.int8)
            m[1:] = flags & WORD
            step = np.diff(m)
            alone = np.flatnonzero(flags & OWN)
            if len(alone):
                first = alone[(self.data[alone] & 0xC0) != 0x80]
                after = alone[(flags[alone + 1] & WORD > 0) & ((self.data[alone + 1] & 0xC0) != 0x80)] + 1
                begin, end = step == 1, step == -1
                begin[first] = True
                begin[after] = True
                end |= begin & (m[:-1] == 1)
                starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
            else:
                starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            self._words = starts, ends, np.searchsorted(starts, self.off)
        return self._words

    def word_hashes(self) -> np.ndarray:
        starts, ends, _ = self.words
        return range_hash(self.folded, starts, ends)

    def normalized(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Folded words with one blank after each; where each byte came from; the first byte of every text."""
        starts, ends, _ = self.words
        size = ends - starts + 1
        place = np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)
        out = self.folded[place]
        out[np.cumsum(size) - 1] = 32
        return out, place, np.searchsorted(place, self.off)

    def char_at(self, row: int, at: int) -> int:
        """The character offset in text ``row`` of byte ``at`` of the array."""
        a = int(self.off[row])
        if int(self.off[row + 1]) - a < 1 << 16:
            return int(np.count_nonzero((self.data[a:at] & 0xC0) != 0x80))
        if self._counted[0] != row:  # a long text may be asked often
            self._counted = row, np.concatenate(([0], np.cumsum((self.data[a : self.off[row + 1]] & 0xC0) != 0x80)))
        return int(self._counted[1][at - a])


#: Letters of a word, and the bits and the first letter of each: no two share one, so that no match begins within a word.
LETTERS = ((58, 6, 0), (52, 6, 64), (45, 7, 128))


def letters(words: np.ndarray) -> str:
    """Words, by ``len(LETTERS)`` letters for each hash, as the text of an automaton, whose states look their followers up one by
    one and so are fast with few of them. What it finds is to be confirmed by whole hashes."""
    out = np.empty((len(words), len(LETTERS)), np.uint8)
    for k, (shift, bits, first) in enumerate(LETTERS):
        out[:, k] = (words >> np.uint64(shift)).astype(np.uint8) & np.uint8((1 << bits) - 1) | np.uint8(first)
    return out.tobytes().decode("latin-1")


def segments(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``first`` (n + 1 starts): the rows that aren't empty, and their starts, as reduceat wants them."""
    rows = np.flatnonzero(first[1:] > first[:-1])
    return rows, first[:-1][rows]


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words; a text of fewer words, but some, has one shingle of them all."""
    n_words = np.diff(first)
    count = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    begin = np.concatenate(([0], np.cumsum(count)))
    total = int(begin[-1])
    at = np.arange(total) + np.repeat(first[:-1] - begin[:-1], count)
    padded = np.concatenate((hashes, np.zeros(k, np.uint64)))
    out = np.zeros(total, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + padded[at + j]
    short = np.flatnonzero((n_words < k) & (n_words > 0))
    for row in short:
        x = 0
        for h in hashes[first[row] : first[row + 1]].tolist():
            x = (x * 0xA0761D6478BD642F + h + 1) & 0xFFFFFFFFFFFFFFFF
        out[begin[row]] = x
    return mix(out), begin
