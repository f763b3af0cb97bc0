"""Token ids as compact binary blocks: an adaptive context-mixing range coder.

The texts of a partition are encoded to token ids and laid end to end. Every ``BLOCK`` ids make a block,
coded with fresh statistics, so that blocks can be decoded alone and in parallel; each carries checksums
of its head, of its ids and of its payload, and the documents it holds.

For each id the predictions of three orders are mixed. Order 2 keeps the ``TWO`` ids that most followed the two
previous ones, order 1 the ``ONE`` that most followed the previous one, order 0 the frequency of all ids. How a
context's counts stand (of order 1 also which of its ids order 2 has guessed) is its state, and adaptive counts by state of
which guess was right, if any, part first the whole, then what order 2 leaves of it; an id that order 2 has guessed, or an empty
place, has no part. Arithmetic coding turns these parts, and an id that no guess has by order 0, into bits.

A block is cut into up to ``LANES`` lanes of neighbouring ids, each with a range coder of its own, which all
learn into the block's statistics; a step codes or decodes one id of every lane of many blocks at a time, so that both
ways are whole-array operations. What was learned is put to use at set steps (1, 2, 4, 8, every 16 to 128, then every 64;
of order 0 at 1, 4, 16, 64, then every 128).

Defined results: null and empty texts have no ids but are listed with 0; texts longer than a block
continue in the next; repeated rows are coded each; a doc_id that is no whole number is listed as null; other columns
are not read; an empty table gives no block. A damaged block raises ValueError when decoded, whichever bit
differs, before anything is read by it. Vocabularies have fewer than 131,072 ids.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .store import doc_key
from .textcol import modest_batches, slices

BLOCK = 1 << 18
LANE_IDS = 1024  # ids of a lane, about
LANES = 256  # of a block at most
GROUP = 24  # blocks coded together: about 50 MB of statistics
MAGIC = b"NFT3"
_HEAD = struct.Struct("<4sIIII")  # magic, ids, vocabulary, checksum of ids, of the body
_SUM = struct.Struct("<I")  # checksum of the head
ID_BITS = 17  # of an id in a context's row, which is the ids and above them the number of their counts
_ID = (1 << ID_BITS) - 1  # in a row, no id
TWO, ONE = 2, 3  # successors that order 2 and order 1 keep
MOST_TWO, MOST_ONE = 15, 7  # the highest counts of a successor
PAIRS = 1 << 17  # contexts of order 2 in a block's table
SCALE, SCALE_1, SCALE_0 = 20, 16, 22  # bits of the parts of order 2, of those of order 1 in what is left, and of order 0's
LEFT, LEAST, LEAST_1 = 1 << 11, 1 << 4, 1 << 5  # least parts: of what order 2 leaves, of its guesses, of order 1's; LEFT * LEAST_1 fills SCALE_1
ONCE, PRIOR = 8, 24  # weight of one occurrence of a branch, and of what is expected beforehand
STEP = 128  # weight of one occurrence in order 0
_BUCKET_BITS = 14
_IN_BUCKET = SCALE_0 - _BUCKET_BITS
_31, _32, _SCALE, _SCALE_0 = np.uint64(31), np.uint64(32), np.uint64(SCALE), np.uint64(SCALE_0)
_WHOLE, _WHOLE_1, _WHOLE_0 = 1 << SCALE, 1 << SCALE_1, 1 << SCALE_0
_LAST, _LAST_0, _MIN = np.uint64(_WHOLE - 1), np.uint64(_WHOLE_0 - 1), np.uint64(1) << _31  # narrower intervals take words out and in
_FULL, _ONES = np.uint64((1 << 63) - 1), np.uint64((1 << 32) - 1)


class _Rows:
    """All combinations of counts that a row can have, numbered, and what each becomes by the id that comes.

    An id's count grows when it comes, and it moves before those that came no more often; one that is absent takes the
    last place if that counts less than 2, and else lowers its count. The tables are by combination and branch (the place of
    the id in the row, or the row's length): the new row's ids are
    ids & keep | (ids & shift) << ID_BITS | id * put, and above what is kept stands the number of its counts.
    """

    def __init__(self, length: int, most: int):
        self.length, self.bits = length, length * ID_BITS
        self.counts = [c for c in itertools.product(range(most + 1), repeat=length) if list(c) == sorted(c, reverse=True)]
        number = {c: k for k, c in enumerate(self.counts)}
        self.empty = (1 << self.bits) - 1
        table = np.zeros((4, len(self.counts) * (length + 1)), np.int64)
        for k, c in enumerate(self.counts):
            for branch in range(length + 1):
                new, at = list(c), min(branch, length - 1)
                keep, shift, put = self.empty, 0, 0
                if branch == length and c[at] >= 2:
                    new[at] -= 1
                else:
                    count = 1 if branch == length else min(most, c[at] + 1)
                    del new[at]
                    to = sum(x > count for x in new)
                    new.insert(to, count)
                    if branch == length or to < at:
                        put = 1 << to * ID_BITS
                        shift = (1 << at * ID_BITS) - put
                        keep = self.empty ^ (shift | _ID << at * ID_BITS)
                table[:, k * (length + 1) + branch] = keep, shift, put, number[tuple(new)] << self.bits
        self.shift, self.put, self.keep = table[1], table[2], table[0] | table[3]

    def next(self, row: np.ndarray, way: np.ndarray, x: np.ndarray) -> np.ndarray:
        new = self.shift.take(way, mode="clip")
        new &= row
        new <<= ID_BITS
        put = self.put.take(way, mode="clip")
        put *= x
        new |= put
        self.keep.take(way, out=put, mode="clip")
        put &= row | ~self.empty
        new |= put
        return new

    def expected(self, more: int) -> tuple[np.ndarray, np.ndarray]:
        """For each combination and set of places that are not to be guessed (one bit each, ``more`` of them): weights of the branches, and which guesses can be right."""
        counts = np.repeat(np.array(self.counts, float), 1 << more, axis=0)
        barred = (np.tile(np.arange(1 << more), len(self.counts))[:, None] >> np.arange(self.length)) & 1 == 1
        can = (counts > 0) & ~barred
        weight = np.concatenate((np.where(can, counts - 0.4, 0), np.full((len(can), 1), 1.2)), axis=1)
        return np.maximum(np.rint(PRIOR * weight / weight.sum(1, keepdims=True)), np.pad(can, ((0, 0), (0, 1)), constant_values=True)).astype(np.int64), can


_TWO, _ONE = _Rows(TWO, MOST_TWO), _Rows(ONE, MOST_ONE)
_EXPECTED_2, _EXPECTED_1 = _TWO.expected(0), _ONE.expected(ONE)


class _Parts:
    """The parts of the branches of each state of many blocks: where branch b begins is at ``flat[b * width + state]``, where it ends ``width`` further."""

    def __init__(self, blocks: int, expected: tuple[np.ndarray, np.ndarray], whole: int, least: int, rest: int):
        weight, can = expected
        self.states, branches = weight.shape
        self.width = blocks * self.states + 1  # the last state: all is the first part
        self.weight = np.zeros((branches, self.width), np.int64)
        self.weight[:, :-1] = np.tile(weight.T, blocks)
        self.weight[0, -1] = 1
        self.least = np.tile(np.cumsum(can, axis=1).T * least, blocks)
        self.share = whole - rest - least * (branches - 1)
        self.ends = np.zeros((branches + 1, self.width), np.int64)
        self.ends[-1] = self.ends[1:, -1] = whole
        self.flat = self.ends.ravel()

    def learn(self, seen: list[np.ndarray]) -> None:
        if seen:
            self.weight += ONCE * np.bincount(np.concatenate(seen), minlength=self.weight.size).reshape(self.weight.shape)
        below = self.weight[:-1].copy()
        for k in range(1, len(below)):
            below[k] += below[k - 1]
        share = self.share / (below[-1] + self.weight[-1])
        self.ends[1:-1, :-1] = (below * share)[:, :-1].astype(np.int64) + self.least


def lanes_of(n: int) -> int:
    return min(LANES, max(1, n // LANE_IDS))


def _by_lane(n: int) -> tuple[int, int]:
    """Lanes of a block of n ids, and the ids of each (the last ones may have fewer)."""
    lanes = lanes_of(n)
    return lanes, -(-n // lanes)


class _Mixture:
    """The adaptive model of many blocks side by side, one position of all their lanes at a time.

    Encoder and decoder keep it alike. Blocks share nothing, so that each can be decoded without the others.
    """

    def __init__(self, sizes: list[int], vocabulary: int, decode: bool = False):
        self.decode = decode
        self.vocabulary = vocabulary
        lanes, steps = (np.array(x, np.int64) for x in zip(*map(_by_lane, sizes))) if sizes else (np.zeros(0, np.int64),) * 2
        self.block = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(self.block)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        self.size = np.clip(np.array(sizes, np.int64)[self.block] - nth * steps[self.block], 0, steps[self.block])
        self.lane = np.arange(len(self.block))
        self.steps = int(self.size.max(initial=0))
        self.ends = set(self.size.tolist())
        n = len(sizes)
        self.after_one = np.full(n * (vocabulary + 1), _ONE.empty, np.int64)
        self.after_two = np.full(n * PAIRS, _TWO.empty, np.int64)
        self.parts_two = _Parts(n, _EXPECTED_2, _WHOLE, LEAST, LEFT)
        self.parts_one = _Parts(n, _EXPECTED_1, _WHOLE_1, LEAST_1, LEAST_1)
        self.freq = np.tile(np.maximum(1, 20000 // (np.arange(vocabulary) + 300)).astype(np.int32), n)  # ids ascend as words get rarer
        self.row = vocabulary + 1
        self.below = np.empty((n, self.row), np.int32)
        self.p1 = np.full(len(self.block), vocabulary, np.int64)
        self.mark = self.p1 * 0x9E3779B1
        self.seen: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        self.missed: list[np.ndarray] = []
        self.odd = np.arange(vocabulary + 1, dtype=np.int32)

    def begin(self, step: int) -> np.ndarray | None:
        """Which of the lanes go on at this step (None: all), after what was learned so far is put to use."""
        if step & (step - 1) == 0 or step % (16 if step < 128 else 64) == 0:
            self.learn(step in (1, 4, 16, 64) or step % 128 == 0)
        self.counts = step < 64 or step % 2 == 0
        on = None
        if step in self.ends:
            on = np.flatnonzero(self.size > step)
            self.block, self.size, self.lane, self.p1, self.mark = (x[on] for x in (self.block, self.size, self.lane, self.p1, self.mark))
        if on is not None or step == 0:
            self.base_1, self.base_2 = self.block * (self.vocabulary + 1), self.block * PAIRS
            self.base_parts_1, self.base_parts_2 = self.block * self.parts_one.states, self.block * self.parts_two.states
            self.base_0, self.base_freq = self.block * self.row, self.block * self.vocabulary
        return on

    def learn(self, order_0: bool) -> None:
        self.parts_two.learn(self.seen[0])
        self.parts_one.learn(self.seen[1])
        self.seen = ([], [])
        if order_0:
            if self.missed:
                np.add.at(self.freq, np.concatenate(self.missed), np.int32(STEP))
                self.missed = []
            total = np.cumsum(self.freq.reshape(len(self.below), -1), axis=1, dtype=np.int32)
            self.below[:, 0] = 0
            np.multiply(total, (_WHOLE_0 - self.vocabulary) / total[:, -1:], out=self.below[:, 1:], casting="unsafe")
            self.below += self.odd
            self.below[:, -1] = _WHOLE_0
            self.flat = self.below.ravel()
            if self.decode:  # the last id that begins at or before each bucket of values
                width = (1 << _BUCKET_BITS) + 1
                first = (self.below[:, : self.vocabulary] + ((1 << _IN_BUCKET) - 1)) >> _IN_BUCKET
                first += np.arange(0, len(first) * width, width, dtype=np.int32)[:, None]
                found = np.cumsum(np.bincount(first.ravel(), minlength=len(first) * width)).reshape(-1, width)
                self.bucket = (found + np.arange(-1, len(found) - 1)[:, None]).ravel()

    def find(self, v: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The places in ``flat`` of the ids in whose parts of order 0 the values lie: by buckets, then by halves."""
        found = self.bucket.take(block * ((1 << _BUCKET_BITS) + 1) + (v >> _IN_BUCKET), mode="clip")
        more = np.flatnonzero(self.flat.take(found + 1, mode="clip") <= v)
        if len(more):
            at, value, end = found[more], v[more], block[more] * self.row + self.row - 1
            step = 1 << _IN_BUCKET  # every id has a part of its own
            while step:
                at += (self.flat.take(np.minimum(at + step, end), mode="clip") <= value) * step
                step >>= 1
            found[more] = at
        return found

    def guess(self) -> None:
        """Look up the rows of both contexts, their guesses, and where the parts of their states begin."""
        self.i1 = self.base_1 + self.p1
        mark = self.p1 * 0x9E3779B1
        i2 = self.mark
        i2 >>= 5
        i2 ^= mark
        i2 >>= 16
        i2 &= PAIRS - 1
        i2 += self.base_2
        self.i2, self.mark = i2, mark
        self.one, self.two = one, two = self.after_one.take(self.i1, mode="clip"), self.after_two.take(i2, mode="clip")
        self.guess_2 = b0, b1 = two & _ID, (two >> ID_BITS) & _ID
        self.guess_1 = one & _ID, (one >> ID_BITS) & _ID, (one >> 2 * ID_BITS) & _ID
        barred = None  # guesses of order 1 that order 2 has made
        for k in range(ONE - 1, -1, -1):
            again = ((self.guess_1[k] == b0) | (self.guess_1[k] == b1)).view(np.uint8)
            barred = again if barred is None else barred + barred + again
        self.counts_2, self.counts_1 = two >> _TWO.bits, one >> _ONE.bits
        self.state_2 = self.base_parts_2 + self.counts_2
        state = self.counts_1 << ONE
        state += barred
        state += self.base_parts_1
        self.state_1 = state

    def branches(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In which place of the rows of order 2 and order 1 the ids are (``TWO``, ``ONE``: in none)."""
        b = np.int8(TWO) - ((self.guess_2[0] == x).view(np.int8) << np.int8(1))
        b -= (self.guess_2[1] == x).view(np.int8)
        a = np.int8(ONE) - (self.guess_1[0] == x).view(np.int8) * np.int8(3)
        a -= (self.guess_1[1] == x).view(np.int8) << np.int8(1)
        a -= (self.guess_1[2] == x).view(np.int8)
        return b.astype(np.int64), a.astype(np.int64)

    def part(self, branch_2: np.ndarray, branch_1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the parts of these branches begin in the mixture, and their sizes; what is learned of them."""
        wide_2, wide_1 = self.parts_two.width, self.parts_one.width
        k2 = branch_2 * wide_2
        k2 += self.state_2
        k1 = branch_1 * wide_1
        k1 += self.state_1
        k1 = np.where(branch_2 == TWO, k1, wide_1 - 1)
        if self.counts:
            self.seen[0].append(k2)
            self.seen[1].append(k1)
        flat_2, flat_1 = self.parts_two.flat, self.parts_one.flat
        begin = flat_2.take(k2, mode="clip")
        size = flat_2.take(k2 + wide_2, mode="clip")
        size -= begin
        low, high = flat_1.take(k1, mode="clip"), flat_1.take(k1 + wide_1, mode="clip")
        low *= size
        low >>= SCALE_1
        high *= size
        high >>= SCALE_1
        begin += low
        high -= low
        return begin.view(np.uint64), high.view(np.uint64)

    def update(self, x: np.ndarray, branch_2: np.ndarray, branch_1: np.ndarray, missed: np.ndarray) -> None:
        """Learn that x came, in these places of the rows, and which lanes no guess was right for."""
        if len(missed):
            self.missed.append(self.base_freq[missed] + x[missed])
        way = self.counts_2 * (TWO + 1)
        way += branch_2
        self.after_two[self.i2] = _TWO.next(self.two, way, x)
        way = self.counts_1 << 2
        way += branch_1
        self.after_one[self.i1] = _ONE.next(self.one, way, x)
        self.p1 = x


def encode_blocks(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """Code blocks of at most ``BLOCK`` ids, all lanes of all of them side by side."""
    if vocabulary >= 1 << ID_BITS:
        raise ValueError(f"a vocabulary has fewer than {1 << ID_BITS} ids")
    m = _Mixture([len(x) for x in blocks], vocabulary)
    block, lanes = m.block, len(m.block)
    ids = np.zeros((m.steps, lanes), np.int32)  # step by step
    done = 0
    for x in blocks:
        own, size = _by_lane(len(x))
        ids[:size, done : done + own] = np.concatenate((x, np.zeros(own * size - len(x), x.dtype))).reshape(own, size).T
        done += own
    low, width, rest = np.zeros(lanes, np.uint64), np.full(lanes, _FULL), np.zeros(lanes, np.uint64)
    words, owners = [], []  # leading words of 33 bits, the highest to be carried into the word before

    def out(which: np.ndarray, low: np.ndarray, width: np.ndarray) -> None:
        """Take the leading words of narrow intervals out; which: their lanes."""
        small = np.flatnonzero(width < _MIN)
        owners.append(which[small])
        lead = low[small]
        words.append(lead >> _31)
        lead &= _MIN - np.uint64(1)
        lead <<= _32
        low[small] = lead
        width[small] <<= _32

    for s in range(m.steps):
        before, on = m.lane, m.begin(s)
        if on is not None:
            rest[before] = low
            low, width = low[on], width[on]
        x = (ids[s] if len(m.lane) == lanes else ids[s][m.lane]).astype(np.int64)
        m.guess()
        branch_2, branch_1 = m.branches(x)
        begin, size = m.part(branch_2, branch_1)
        width >>= _SCALE
        begin *= width
        low += begin
        width *= size
        out(m.lane, low, width)
        missed = np.flatnonzero((branch_2 == TWO) & (branch_1 == ONE))
        k = m.base_0[missed]
        k += x[missed]
        a = m.flat.take(k, mode="clip").astype(np.uint64)
        k += 1
        size = m.flat.take(k, mode="clip").astype(np.uint64)
        size -= a
        lane, low_0, width_0 = m.lane[missed], low[missed], width[missed]
        width_0 >>= _SCALE_0
        a *= width_0
        low_0 += a
        width_0 *= size
        out(lane, low_0, width_0)
        low[missed], width[missed] = low_0, width_0
        m.update(x, branch_2, branch_1, missed)
    rest[m.lane] = low
    words.append((rest + (_MIN - np.uint64(1))) >> _31)
    owners.append(np.arange(lanes, dtype=np.int32))
    owner = np.concatenate(owners)
    length = np.bincount(owner, minlength=lanes)
    whole = np.concatenate(words)[np.argsort(owner, kind="stable")]
    while len(over := np.flatnonzero(whole >> _32)):  # never the first word of a lane
        whole[over] &= _ONES
        whole[over - 1] += np.uint64(1)
    whole, stop = whole.astype("<u4"), np.concatenate(([0], np.cumsum(length)))
    coded, cut = [], np.searchsorted(block, np.arange(len(blocks) + 1))
    for k, x in enumerate(blocks):
        mine = range(cut[k], cut[k + 1])
        body = length[mine.start : mine.stop].astype("<u4").tobytes() + whole[stop[mine.start] : stop[mine.stop]].tobytes()
        head = _HEAD.pack(MAGIC, len(x), vocabulary, zlib.crc32(x.astype("<u4").tobytes()), zlib.crc32(body))
        coded.append(head + _SUM.pack(zlib.crc32(head)) + body)
    return coded


def _opened(payload: bytes) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """Ids, vocabulary, checksum of the ids, words of each lane, all words; ValueError if the block isn't whole."""
    size = _HEAD.size + _SUM.size
    if len(payload) < size or _SUM.unpack_from(payload, _HEAD.size)[0] != zlib.crc32(payload[: _HEAD.size]):
        raise ValueError("damaged head of a block")
    magic, n, vocabulary, ids_sum, body_sum = _HEAD.unpack_from(payload)
    body = payload[size:]
    if magic != MAGIC or n > BLOCK or vocabulary >= 1 << ID_BITS or zlib.crc32(body) != body_sum:
        raise ValueError("damaged block")
    lanes = lanes_of(n)
    if len(body) % 4 or len(body) < 4 * lanes:
        raise ValueError("damaged block")
    length, words = np.frombuffer(body, "<u4", lanes).astype(np.int64), np.frombuffer(body, "<u4", offset=4 * lanes)
    if int(length.sum()) != len(words):
        raise ValueError("damaged block")
    return n, vocabulary, ids_sum, length, words


def decode_blocks(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of blocks of one vocabulary, decoded side by side; ValueError if one isn't whole."""
    if len(payloads) > GROUP:
        return [x for k in range(0, len(payloads), GROUP) for x in decode_blocks(payloads[k : k + GROUP])]
    opened = [_opened(p) for p in payloads]
    if not opened:
        return []
    vocabulary = opened[0][1]
    if any(v != vocabulary for _, v, *_ in opened):
        return [decode_blocks([p])[0] for p in payloads]
    sizes = [n for n, *_ in opened]
    m = _Mixture(sizes, vocabulary, decode=True)
    lanes = len(m.block)
    out = np.zeros((m.steps, lanes), np.int32)
    words = np.concatenate([*(w for *_, w in opened), np.zeros(2, np.uint32)]).astype(np.uint64)
    stop = np.cumsum(np.concatenate([n for *_, n, _ in opened]))
    nothing = len(words) - 1
    ahead = np.concatenate(([0], stop[:-1]))
    # An interval has 63 bits, so the code's second word and all after it are read by halves: its last bit goes with the next one's others.
    low = words[np.where(ahead < stop, ahead, nothing)] << _31 | words[np.where(ahead + 1 < stop, ahead + 1, nothing)] >> np.uint64(1)
    width = np.full(lanes, _FULL)
    words[stop] = 0  # the next lane's first, which is in low already
    words[1:] = (words[:-1] & np.uint64(1)) << _31 | words[1:] >> np.uint64(1)
    ahead += 2

    def take_in(low: np.ndarray, width: np.ndarray, which: np.ndarray | None) -> None:
        """Let the next words into narrow intervals; which: their lanes (None: all)."""
        small = np.flatnonzero(width < _MIN)
        lane = small if which is None else which[small]
        k = ahead[lane]
        low[small] = low[small] << _32 | words[np.where(k <= stop[lane], k, nothing)]
        width[small] <<= _32
        ahead[lane] = k + 1

    for s in range(m.steps):
        on = m.begin(s)
        if on is not None:
            low, width, ahead, stop = (v[on] for v in (low, width, ahead, stop))
        m.guess()
        width >>= _SCALE
        value = np.minimum(low // width, _LAST).view(np.int64)
        flat_2, flat_1 = m.parts_two.flat, m.parts_one.flat
        wide_2, wide_1 = m.parts_two.width, m.parts_one.width
        branch_2 = (value >= flat_2.take(m.state_2 + wide_2, mode="clip")).view(np.int8)
        end = flat_2.take(m.state_2 + TWO * wide_2, mode="clip")
        absent = value >= end
        branch_2 = branch_2 + absent.view(np.int8)
        value -= end
        left = _WHOLE - end
        branch_1 = np.zeros(len(low), np.int8)
        for k in range(1, ONE + 1):
            end = flat_1.take(m.state_1 + k * wide_1, mode="clip")
            end *= left
            end >>= SCALE_1
            branch_1 += (value >= end).view(np.int8)
        begin, size = m.part(branch_2.astype(np.int64), branch_1.astype(np.int64))
        begin *= width
        low -= begin
        width *= size
        take_in(low, width, None)
        x = np.where(absent, m.one, m.two)
        x >>= np.where(absent, branch_1, branch_2) * np.int8(ID_BITS)
        x &= _ID
        missed = np.flatnonzero(absent & (branch_1 == ONE))
        if len(missed):
            low_0, width_0 = low[missed], width[missed]
            width_0 >>= _SCALE_0
            v = np.minimum(low_0 // width_0, _LAST_0).astype(np.int32)
            own = m.block[missed]
            k = m.find(v, own)
            x[missed] = k - own * m.row
            a = m.flat.take(k, mode="clip").astype(np.uint64)
            size = m.flat.take(k + 1, mode="clip").astype(np.uint64)
            size -= a
            a *= width_0
            low_0 -= a
            width_0 *= size
            take_in(low_0, width_0, missed)
            low[missed], width[missed] = low_0, width_0
        if len(m.lane) == lanes:
            out[s] = x
        else:
            out[s, m.lane] = x
        m.update(x, *m.branches(x), missed)
    found, done = [], 0
    for n in sizes:
        own, size = _by_lane(n)
        found.append(out[:size, done : done + own].T.ravel()[:n])
        done += own
    for x, (_, _, ids_sum, *_) in zip(found, opened):
        if zlib.crc32(x.astype("<u4").tobytes()) != ids_sum:
            raise ValueError("damaged block")
    return found


def decode_block(payload: bytes) -> np.ndarray:
    """The ids of one block; ValueError if it isn't whole."""
    return decode_blocks([payload])[0]


BLOCKS = "stream int, block int, first_doc bigint, doc_ids array<bigint>, doc_tokens array<int>, n_tokens int, checksum bigint, payload binary"


def _blocks(batches: Iterator[pa.RecordBatch], sent, key: str, check: bool) -> Iterator[pa.RecordBatch]:
    words = bpe.vocabulary_of(sent, key)
    stream = TaskContext.get().partitionId()
    done: list[tuple[int, list, list[int], np.ndarray]] = []
    ids, docs, sizes, held = [], [], [], 0  # of the open block
    first, block = 0, 0

    def close() -> None:
        nonlocal ids, docs, sizes, held, first
        done.append((first, docs, sizes, np.concatenate(ids) if ids else np.zeros(0, np.int32)))
        first += len(docs)
        ids, docs, sizes, held = [], [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal block, done
        coded = encode_blocks([x for *_, x in done], words.size)
        right = [pa.array([np.array_equal(x, y) for (*_, x), y in zip(done, decode_blocks(coded))])] if check else []
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([stream] * len(done), pa.int32()), pa.array(range(block, block + len(done)), pa.int32()), pa.array([d[0] for d in done], pa.int64()),
                pa.array([d[1] for d in done], pa.list_(pa.int64())), pa.array([d[2] for d in done], pa.list_(pa.int32())), pa.array([len(d[3]) for d in done], pa.int32()),
                pa.array([_HEAD.unpack_from(c)[3] for c in coded], pa.int64()), pa.array(coded, pa.binary()), *right,
            ],
            ["stream", "block", "first_doc", "doc_ids", "doc_tokens", "n_tokens", "checksum", "payload", *["round_trip"] * check],
        )
        block += len(done)
        done = []

    for batch in batches:
        names, at = batch.column("doc_id").to_pylist(), 0
        for part in slices(batch.column("text")):
            tokens, begin = words.encode(part)
            for k in range(len(part)):
                own = tokens[begin[k] : begin[k + 1]]
                while True:
                    room = own[: BLOCK - held]
                    ids.append(room)
                    docs.append(names[at + k])
                    sizes.append(len(room))
                    held += len(room)
                    own = own[len(room) :]
                    if held < BLOCK:
                        break
                    close()
                    if not len(own):
                        break
                    first -= 1  # the document goes on
                if len(done) >= GROUP:
                    yield from flush()
            at += len(part)
    if docs:
        close()
    if done:
        yield from flush()


def write_blocks(docs: DataFrame, path: str = bpe.VOCABULARY, check: bool = False) -> DataFrame:
    """Blocks of the documents' token ids, in the order of each partition.

    ``stream`` and ``block`` number them; ``first_doc`` is the number, within the stream, of the first of
    ``doc_ids``; ``doc_tokens`` counts each one's ids here. A document that continues has the same number.
    With ``check``, every block is decoded again, and ``round_trip`` says whether that gave its ids.
    """
    modest_batches(docs.sparkSession)
    sent, key = bpe.send(docs, path)
    return docs.select(doc_key(), "text").mapInArrow(lambda it: _blocks(it, sent, key, check), BLOCKS + ", round_trip boolean" * check)


_PARTS = pa.schema([("stream", pa.int32()), ("number", pa.int64()), ("block", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _decoded(few: list[pa.RecordBatch]) -> pa.RecordBatch:
    """A row for each document's part of each of a few blocks."""
    b = pa.Table.from_batches(few).combine_chunks().to_batches()[0]
    ids = decode_blocks(b.column("payload").to_pylist())
    docs, tokens = b.column("doc_ids"), b.column("doc_tokens")
    block = pc.list_parent_indices(docs).to_numpy()
    sizes = tokens.flatten().to_numpy()
    nth = np.arange(len(block)) - np.searchsorted(block, block)
    number = b.column("first_doc").to_numpy()[block] + nth
    offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32)
    flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32, copy=False)
    own = pa.array(block)
    return pa.RecordBatch.from_arrays([b.column("stream").take(own), pa.array(number), b.column("block").take(own), docs.flatten(), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema=_PARTS)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decoded ``GROUP`` blocks at a time, whatever batches they come in; nothing of a group is held while the next one is decoded."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            held.append(b.slice(0, GROUP - n))
            n += held[-1].num_rows
            b = b.slice(held[-1].num_rows)
            if n == GROUP:
                yield _decoded(held)
                held, n = [], 0
    if held:
        yield _decoded(held)


def read_blocks(blocks: DataFrame) -> DataFrame:
    """One row for each document in the blocks: doc_id, token_ids."""
    modest_batches(blocks.sparkSession)
    parts = blocks.mapInArrow(_parts, "stream int, number bigint, block int, doc_id bigint, ids array<int>")
    whole = parts.groupBy("stream", "number").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("block", "ids"))).alias("p"))
    return whole.select("doc_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("token_ids"))
