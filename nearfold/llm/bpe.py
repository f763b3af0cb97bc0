"""Byte-level BPE encoding and decoding by depth-first traversal of a trie of distinct words.

Texts are cut into words as the vocabulary's pattern does, by character classes over whole Arrow
columns. The distinct words of a batch form a trie; sorted, they are its depth-first order. On the way
down, each node gets its last-token state: the last token of the encoding of the prefix that ends
there. It is the one token that ends at the node, and whose pair with the last token of the prefix
before it stays unmerged when the two are encoded together. A prefix that many words share is therefore
encoded once; a word's tokens are read back along the last-token states. Workers keep the words they
have encoded, up to ``CACHE_WORDS``, as arrays.

Words count as equal if their 64-bit hashes and lengths are; words of more than ``LONG`` bytes are
compared in full.

Defined results: a null text has null tokens, an empty one none; a text is encoded whole; strings of
special tokens are ordinary text; repeated rows are encoded alike; other columns are not read; an empty
table gives no rows; doc_id keeps its type and may be null. Null
tokens decode to null, an empty list to an empty text, and a list with an id outside the vocabulary to
null; bytes that aren't UTF-8 are replaced.
"""

from __future__ import annotations

import base64
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcol import TextBatch, arrow_column, range_hash, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Encoded words that a worker keeps; beyond it, it starts anew.
CACHE_WORDS = 1_500_000
QUICK_BITS = 20
LONG = 512

L, N, O, SP, WS, END = 1, 2, 3, 4, 5, 6
_SPACES = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    global _CLASS
    if _CLASS is None:
        kinds = {"L": L, "N": N}
        out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], O) for c in range(0x110000)), np.uint8, 0x110000)
        out[_SPACES] = WS
        out[32] = SP
        _CLASS = out
    return _CLASS


def pretokens(batch: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of all texts, which cover them; each text's first word (n + 1 entries)."""
    data = batch.data
    lead = (data & 0xC0) != 0x80
    pos = np.flatnonzero(lead)
    head = data[pos]
    cp = head.astype(np.uint32)
    for low, high, more, mask in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0x100, 3, 0x07)):
        at = np.flatnonzero((head >= low) & (head < high))
        if len(at):
            c = data[pos[at]].astype(np.uint32) & mask
            for k in range(1, more + 1):
                c = (c << np.uint32(6)) | (data[np.minimum(pos[at] + k, len(data) - 1)] & 0x3F)
            cp[at] = c
    cls = _classes()[np.minimum(cp, 0x10FFFF)]
    last = np.searchsorted(pos, batch.off[1:] - 1)  # the added line feeds
    cls[last] = END
    before = np.concatenate(([END], cls[:-1])).astype(np.uint8)
    after = np.concatenate((cls[1:], [END])).astype(np.uint8)
    blank, blank_before = (cls == SP) | (cls == WS), (before == SP) | (before == WS)
    start = (blank & (~blank_before | ((after < SP)))) | (~blank & (cls != before) & (before != SP)) | (cls == END)
    quote = np.flatnonzero((cp == 39) & (before != O) & (before != SP) & (after == L))
    if len(quote):
        c1, c2 = cp[np.minimum(quote + 1, len(cp) - 1)], cp[np.minimum(quote + 2, len(cp) - 1)]
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        start[quote[one | two] + 1] = False
        start[quote[one] + 2] = True
        start[quote[two & ~one] + 3] = True
    begins = pos[start]
    ends = np.concatenate((begins[1:], [len(data)])) if len(begins) else begins
    keep = np.ones(len(begins), bool)
    keep[np.searchsorted(begins, batch.off[1:] - 1)] = False
    begins, ends = begins[keep], ends[keep]
    return begins, ends, np.searchsorted(begins, batch.off)


class Vocabulary:
    """Ranks of byte strings; a token's rank is its id, and single bytes come first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values(), default=-1) + 1
        self.bytes = [b""] * self.size
        for b, k in ranks.items():
            self.bytes[k] = b
        #: The pair whose merge makes each token; itself twice for a single byte.
        self.split = [self._halves(b, k) for k, b in enumerate(self.bytes)]
        self.merged = {(a << 20) | b: k for k, (a, b) in enumerate(self.split) if a != k}
        self.pairs: dict[int, bool] = {}
        self.forget()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _halves(self, word: bytes, rank: int) -> tuple[int, int]:
        parts = [bytes([c]) for c in word]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (rank, rank)

    def stays(self, a: int, b: int) -> bool:
        """Whether the tokens a, b are the encoding of their bytes: no merge across the seam comes before those within."""
        key = (a << 20) | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        merged, split = self.merged, self.split
        limit, ok = 1 << 60, True
        while True:
            joint = merged.get((a << 20) | b)
            if joint is not None and joint < limit:
                ok = False
                break
            if a > b:
                limit, a = a, split[a][1]
                if a == limit:
                    limit, b = b + 1, split[b][0]
                    if b + 1 == limit:
                        break
            else:
                limit, b = b + 1, split[b][0]
                if b + 1 == limit:
                    limit, a = a, split[a][1]
                    if a == limit:
                        break
        if len(self.pairs) > 4_000_000:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def _prepare(self) -> None:
        """States of a matcher for tokens: a state is the longest end of what was read that begins some token."""
        self.prefix: dict[bytes, int] = {b"": 0}
        for token in self.bytes:
            for n in range(1, len(token) + 1):
                self.prefix.setdefault(token[:n], len(self.prefix))
        self.names = list(self.prefix)
        self.moves: dict[int, int] = {}
        self.endings: list[list[tuple[int, int]] | None] = [None] * len(self.names)

    def _move(self, state: int, byte: int) -> int:
        word = self.names[state] + bytes([byte])
        while word not in self.prefix:
            word = word[1:]
        self.moves[(state << 8) | byte] = to = self.prefix[word]
        if self.endings[to] is None:
            self.endings[to] = [(len(word) - i, t) for i in range(len(word)) if (t := self.ranks.get(word[i:])) is not None]
        return to

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of distinct words, by a walk over their trie in depth-first (sorted) order."""
        if not hasattr(self, "prefix"):
            self._prepare()
        table, pairs, moves, endings = self.bytes, self.pairs, self.moves, self.endings
        out: list[list[int]] = [[]] * len(words)
        path: list[int] = [-1]  # last-token states of the prefixes of the word at hand
        states: list[int] = [0]  # and what the tokens' matcher has read
        prior = b""
        for k in sorted(range(len(words)), key=words.__getitem__):
            w = words[k]
            same, most = 0, min(len(w), len(prior))
            while same < most and w[same] == prior[same]:
                same += 1
            del path[same + 1 :], states[same + 1 :]
            state = states[same]
            for d in range(same + 1, len(w) + 1):
                key = (state << 8) | w[d - 1]
                state = moves.get(key)
                if state is None:
                    state = self._move(key >> 8, key & 255)
                states.append(state)
                for n, t in endings[state]:  # tokens that end here, the longest first
                    if n == d:
                        path.append(t)
                        break
                    before = path[d - n]
                    ok = pairs.get((before << 20) | t)
                    if ok or ok is None and self.stays(before, t):
                        path.append(t)
                        break
                else:
                    raise ValueError("the vocabulary lacks a single byte")
            tokens, d = [], len(w)
            while d:
                tokens.append(path[d])
                d -= len(table[path[d]])
            tokens.reverse()
            out[k] = tokens
            prior = w
        return out

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of encoded words
        self.slot = np.zeros(0, np.int64)
        self.begin = np.zeros(1, np.int64)
        self.tokens = np.zeros(0, np.int32)
        # Where most words are found at once: by their leading bits, each place kept by the first that came.
        self.at_once = np.zeros(1 << QUICK_BITS, np.uint64)
        self.slot_at_once = np.zeros(1 << QUICK_BITS, np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts of one slice: tokens, and where each text's begin (n + 1 entries)."""
        batch = TextBatch(column)
        begins, ends, first = pretokens(batch)
        if not len(begins):
            return np.zeros(0, np.int32), np.zeros(batch.n + 1, np.int64)
        hashes = range_hash(batch.data, begins, ends)
        long = np.flatnonzero(ends - begins > LONG)
        if len(long):  # compared in full: each gets a number of its own
            own: dict[bytes, int] = {}
            for i in long.tolist():
                hashes[i] = own.setdefault(batch.data[begins[i] : ends[i]].tobytes(), len(own) + 1)  # 0 marks an empty place
            self.forget()
        slot = self._slots(batch, begins, ends, hashes)
        low = self.begin[slot]
        count = self.begin[slot + 1] - low
        total = np.concatenate(([0], np.cumsum(count)))
        tokens = self.tokens[np.arange(int(total[-1])) + np.repeat(low - total[:-1], count)]
        if len(long):
            self.forget()
        return tokens, total[first]

    def _slots(self, batch: TextBatch, begins: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Where the encodings of words are kept; new words are encoded."""
        place = (hashes >> np.uint64(64 - QUICK_BITS)).astype(np.int64)
        slot = self.slot_at_once.take(place).astype(np.int64)
        missed = np.flatnonzero(self.at_once.take(place) != hashes)
        if not len(missed):
            return slot
        distinct, example, inverse = np.unique(hashes[missed], return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != distinct
        if len(self.known) and len(self.known) + int(new.sum()) > CACHE_WORDS:
            self.forget()
            return self._slots(batch, begins, ends, hashes)
        fresh = np.flatnonzero(new)
        if len(fresh):
            raw = batch.data.tobytes()
            pick = missed[example[fresh]]
            encoded = self.encode_words([raw[a:b] for a, b in zip(begins[pick].tolist(), ends[pick].tolist())])
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            slots = len(self.begin) - 1 + np.arange(len(encoded))
            self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(sizes)))
            self.tokens = np.concatenate((self.tokens, np.fromiter((t for e in encoded for t in e), np.int32, int(sizes.sum()))))
            self.known = np.insert(self.known, at[fresh], distinct[fresh])
            self.slot = np.insert(self.slot, at[fresh], slots)
            place = place[pick]
            free = np.flatnonzero(self.at_once[place] == 0)
            self.at_once[place[free]] = distinct[fresh][free]
            own = self.at_once[place] == distinct[fresh]  # of several for one place the last was kept
            self.slot_at_once[place[own]] = slots[own]
        slot[missed] = self.slot[np.searchsorted(self.known, distinct)][inverse]
        return slot

    def spell(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of tokens, and where each token's begin (n + 1 entries)."""
        if not hasattr(self, "_flat"):
            self._size = np.fromiter(map(len, self.bytes), np.int64, self.size)
            self._from = np.concatenate(([0], np.cumsum(self._size)))
            self._flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        size = self._size[t]
        total = np.concatenate(([0], np.cumsum(size)))
        return self._flat[np.arange(int(total[-1])) + np.repeat(self._from[t] - total[:-1], size)], total

    def decode(self, ids: pa.Array) -> list[str | None]:
        """The texts of a list column."""
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.concatenate(([0], np.cumsum(sizes)))
        t = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        wrong = (t < 0) | (t >= self.size)
        data, total = self.spell(np.where(wrong, 0, t))
        off = total[first]
        bad = np.concatenate(([0], np.cumsum(wrong)))
        null = (bad[first[1:]] > bad[first[:-1]]) | ids.is_null().to_numpy(zero_copy_only=False)
        raw = data.tobytes()
        return [None if n else raw[a:b].decode("utf-8", "replace") for n, a, b in zip(null.tolist(), off[:-1].tolist(), off[1:].tolist())]


_WORKERS: dict[str, Vocabulary] = {}
ENCODED = "array<int>"
CHECKED = "struct<token_ids:array<int>,round_trip:boolean>"
_CHECKED = pa.struct([("token_ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])


def vocabulary_of(sent, key: str) -> Vocabulary:
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = sent.value
    return _WORKERS[key]


def _encode(text: pa.Array, sent, key: str) -> pa.Array:
    words = vocabulary_of(sent, key)
    out = []
    for part in slices(text):
        tokens, first = words.encode(part)
        out.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tokens), mask=part.is_null() if part.null_count else None))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))


def _encode_checked(text: pa.Array, sent, key: str) -> pa.Array:
    words = vocabulary_of(sent, key)
    lists, right = [], []
    for part in slices(text):
        tokens, first = words.encode(part)
        lists.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tokens), mask=part.is_null() if part.null_count else None))
        right.append(pc.equal(pa.array(words.decode(lists[-1]), part.type), part))
    if not lists:
        return pa.array([], _CHECKED)
    return pa.StructArray.from_arrays([pa.concat_arrays(lists), pa.concat_arrays(right)], fields=list(_CHECKED))


def _decode(ids: pa.Array, sent, key: str) -> pa.Array:
    words, out, at = vocabulary_of(sent, key), [], 0
    total = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    while at < len(ids):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 19), "right")))
        out += words.decode(ids.slice(at, stop - at))
        at = stop
    return pa.array(out, pa.string())


def send(docs: DataFrame, path: str) -> tuple:
    """The vocabulary, read here, for all workers."""
    return docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path)), uuid.uuid4().hex


def encode_column(docs: DataFrame, text: Column, path: str = VOCABULARY) -> Column:
    return arrow_column(_encode, ENCODED, *send(docs, path))(text)


def decode_column(docs: DataFrame, ids: Column, path: str = VOCABULARY) -> Column:
    return arrow_column(_decode, "string", *send(docs, path))(ids)


def encode_checked(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """As ``encode``, with round_trip: whether the tokens, decoded, are the text (null for a null text)."""
    coded = docs.select("doc_id", arrow_column(_encode_checked, CHECKED, *send(docs, path))(F.col("text")).alias("x"))
    return coded.select("doc_id", F.size("x.token_ids").alias("n_tokens"), "x.token_ids", "x.round_trip")


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row for each document: doc_id, n_tokens, token_ids."""
    return docs.select("doc_id", encode_column(docs, F.col("text"), path).alias("token_ids")).select("doc_id", F.size("token_ids").alias("n_tokens"), "token_ids")


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row for each of ``tokens``: doc_id, text."""
    return tokens.select("doc_id", decode_column(tokens, F.col("token_ids"), path).alias("text"))
