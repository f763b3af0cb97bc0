"""BPE against a public implementation of the same vocabulary; blocks against exact round trips."""

import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from awkward_rows import awkward_rows, prose
from nearfold.llm import bpe, tokenbin

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def public(vocabulary):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def encode(vocabulary, texts):
    out = []
    for part in bpe.slices(pa.array(texts, pa.string())):
        tokens, first = vocabulary.encode(part)
        out += [tokens[a:b].tolist() for a, b in zip(first, first[1:])]
    return out


piece = st.sampled_from(["a", "the", "'", "'s", "'ll", " ", "  ", "\n", "\t", ".", "-", "1", "23", "é", "ó", "n", "ñ", "東", "🙂", " ", "　", "X", "re", "<|endoftext|>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(piece, max_size=25).map("".join), max_size=5))
def test_encodes_like_the_public_implementation(vocabulary, public, texts):
    assert encode(vocabulary, texts) == [public.encode_ordinary(t) for t in texts]


def test_encodes_documents(vocabulary, public, texts):
    own = list(texts.values())
    got = encode(vocabulary, own)
    assert got == [public.encode_ordinary(t) for t in own]
    assert vocabulary.decode(pa.array(got, pa.list_(pa.int32()))) == own


@pytest.mark.parametrize("text", ["z" * 5000, " " * 2000 + "end", "ab" * 3000 + " " + "ba" * 3000, "\n" * 700])
def test_long_words(vocabulary, public, text):
    assert encode(vocabulary, [text, text, "short"]) == [public.encode_ordinary(t) for t in (text, text, "short")]


def test_cache_restarts(vocabulary, public, texts, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 500)
    own = list(texts.values())[:30]
    for _ in range(2):
        assert [encode(vocabulary, [t])[0] for t in own] == [public.encode_ordinary(t) for t in own]


def test_encode_awkward(spark, awkward, empty, public):
    got = sorted(repr((r.doc_id, r.token_ids, r.round_trip)) for r in bpe.encode_checked(awkward).collect())
    assert got == sorted(repr((i, None, None) if t is None else (i, public.encode_ordinary(t), True)) for i, t, *_ in awkward_rows())
    back = bpe.decode(bpe.encode(awkward))
    assert sorted(map(repr, [(r.doc_id, r.text) for r in back.collect()])) == sorted(map(repr, [(i, t) for i, t, *_ in awkward_rows()]))
    assert bpe.encode(empty).count() == 0


def test_decode_defined_cases(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [50256]), (4, [-1]), (5, [72, None]), (6, [127])], "doc_id bigint, token_ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(rows).collect()}
    assert got == {1: None, 2: "", 3: None, 4: None, 5: None, 6: "�"}


def test_blocks_round_trip():
    r = np.random.default_rng(0)
    for size in (0, 1, 2, 63, 1024, 5000, 70001):
        for vocabulary in (2, 300, 50257, 131071):
            if size == 70001 and vocabulary != 50257:
                continue
            ids = np.minimum(r.zipf(1.3, size), vocabulary) - 1
            assert (tokenbin.decode_block(tokenbin.encode_blocks([ids], vocabulary)[0]) == ids).all()
    with pytest.raises(ValueError):
        tokenbin.encode_blocks([np.zeros(1, np.int64)], 131072)


def test_blocks_side_by_side_are_as_alone():
    r = np.random.default_rng(1)
    many = [np.zeros(5000, np.int64), r.integers(0, 9, 100), np.tile(np.arange(50), 60), np.zeros(0, np.int64), r.integers(0, 50257, 4000), np.minimum(r.zipf(1.2, 3 * tokenbin.LANE_IDS + 7), 50257) - 1]
    coded = tokenbin.encode_blocks(many, 50257)
    assert coded == [tokenbin.encode_blocks([x], 50257)[0] for x in many]
    assert all((x == y).all() for x, y in zip(tokenbin.decode_blocks(coded), many))
    assert all((tokenbin.decode_block(c) == x).all() for c, x in zip(coded, many))
    assert len(coded[0]) < 300
    other = tokenbin.encode_blocks([np.arange(70) % 7], 7)[0]
    assert [x.tolist() for x in tokenbin.decode_blocks([coded[1], other])] == [many[1].tolist(), (np.arange(70) % 7).tolist()]
    assert tokenbin.decode_blocks([]) == [] and tokenbin.encode_blocks([], 9) == []


def test_a_whole_block_of_documents(vocabulary):
    """Fewer than 7.5 bits an id, and fewer than order 0 alone could reach with frequencies known beforehand."""
    import pyarrow.parquet as pq

    own = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    ids = np.array([t for x in encode(vocabulary, own) for t in x])
    blocks = [ids[a : a + tokenbin.BLOCK] for a in range(0, len(ids), tokenbin.BLOCK)]
    coded = tokenbin.encode_blocks(blocks, vocabulary.size)
    assert all((x == y).all() for x, y in zip(tokenbin.decode_blocks(coded), blocks))
    assert sum(map(len, coded)) * 8 / len(ids) < 7.5
    for x, c in zip(blocks, coded):
        n = np.bincount(x)
        n = n[n > 0]
        assert len(c) * 8 < -(n * np.log2(n / len(x))).sum()


def test_sure_guesses_cost_little():
    """A whole block of repeats takes about a word or two of each lane."""
    for period in (1, 3, 50, 700):
        ids = np.tile(np.arange(period) + 9, tokenbin.BLOCK // period)
        coded = tokenbin.encode_blocks([ids], 50257)[0]
        assert (tokenbin.decode_block(coded) == ids).all() and len(coded) < 3800


def test_whatever_can_come_has_a_part():
    """However sure one branch has become, all others that can come keep a part, in the whole and in what order 2 leaves; those that can't have none."""
    whole_2, whole_1 = 1 << tokenbin.SCALE, 1 << tokenbin.SCALE_1
    for sure_2 in range(tokenbin.TWO + 1):
        two = tokenbin._Parts(2, tokenbin._EXPECTED_2, whole_2, tokenbin.LEAST, tokenbin.LEFT)
        two.learn([np.repeat(np.arange(sure_2 * two.width, (sure_2 + 1) * two.width - 1), 9999)])
        size_2 = np.diff(two.ends, axis=0)[:, :-1]
        can = np.tile(tokenbin._EXPECTED_2[1].T, 2)
        assert (size_2[:-1][can] > 0).all() and size_2[-1].min() >= tokenbin.LEFT and (size_2.sum(0) == whole_2).all()
        if sure_2 == tokenbin.TWO:
            assert not size_2[:-1][~can].any()
    for sure_1 in range(tokenbin.ONE + 1):
        one = tokenbin._Parts(1, tokenbin._EXPECTED_1, whole_1, tokenbin.LEAST_1, tokenbin.LEAST_1)
        one.learn([np.repeat(np.arange(sure_1 * one.width, (sure_1 + 1) * one.width - 1), 9999)])
        can = tokenbin._EXPECTED_1[1].T
        left = np.diff(one.ends[:, :-1] * tokenbin.LEFT >> tokenbin.SCALE_1, axis=0)
        assert (left[:-1][can] > 0).all() and left[-1].min() > 0 and (left.sum(0) == tokenbin.LEFT).all()
        if sure_1 == tokenbin.ONE:
            assert not left[:-1][~can].any()


def test_rows_keep_the_latest_of_the_most_frequent():
    """Rows of a context, by their tables, against plain lists."""
    r = random.Random(5)
    for rows, most in ((tokenbin._TWO, tokenbin.MOST_TWO), (tokenbin._ONE, tokenbin.MOST_ONE)):
        row, plain = rows.empty, []  # [id, count], the most frequent first
        for _ in range(20000):
            x = min(int(r.expovariate(0.5)), 131070) if r.random() < 0.9 else r.choice((0, 131070, r.randrange(131071)))
            at = next((k for k, (i, _) in enumerate(plain) if i == x), rows.length)
            way = np.array([(row >> rows.bits) * (rows.length + 1) + at])
            row = int(rows.next(np.array([row]), way, np.array([x]))[0])
            if at == rows.length and len(plain) == rows.length and plain[-1][1] >= 2:
                plain[-1][1] -= 1
            else:
                count = min(most, plain.pop(at)[1] + 1) if at < rows.length else 1
                del plain[rows.length - 1 :]
                plain.insert(sum(c > count for _, c in plain), [x, count])
            got = [(row >> k * tokenbin.ID_BITS) & tokenbin._ID for k in range(rows.length)]
            assert got == [i for i, _ in plain] + [tokenbin._ID] * (rows.length - len(plain))
            assert rows.counts[row >> rows.bits] == tuple([c for _, c in plain] + [0] * (rows.length - len(plain)))


def test_damage_is_noticed():
    whole = tokenbin.encode_blocks([np.arange(3000) % 700], 50257)[0]
    head = tokenbin._HEAD.size + tokenbin._SUM.size
    r = random.Random(1)
    for at, bit in [(a, b) for a in range(head) for b in range(8)] + [(r.randrange(head, len(whole)), r.randrange(8)) for _ in range(60)]:
        broken = whole[:at] + bytes([whole[at] ^ (1 << bit)]) + whole[at + 1 :]
        with pytest.raises(ValueError):
            tokenbin.decode_block(broken)
    for cut in (0, 10, head, head + 3, len(whole) - 1):
        with pytest.raises(ValueError):
            tokenbin.decode_block(whole[:cut])
    forged = tokenbin._HEAD.pack(tokenbin.MAGIC, 1 << 31, 50257, 0, 0)
    with pytest.raises(ValueError):
        tokenbin.decode_block(forged + tokenbin._SUM.pack(tokenbin.zlib.crc32(forged)))


def test_write_and_read_blocks(spark, awkward, empty, public, monkeypatch):
    blocks = tokenbin.write_blocks(awkward)
    got = sorted(repr((r.doc_id, r.token_ids)) for r in tokenbin.read_blocks(blocks).collect())
    assert got == sorted(repr((i, public.encode_ordinary(t or ""))) for i, t, *_ in awkward_rows())
    assert blocks.agg(F.sum("n_tokens")).first()[0] == sum(len(public.encode_ordinary(t or "")) for _, t, *_ in awkward_rows())
    assert tokenbin.write_blocks(empty).count() == 0
    checked = tokenbin.write_blocks(awkward, check=True).collect()
    assert checked and all(r.round_trip for r in checked)


def test_long_documents_go_on_in_the_next_block(spark, public, monkeypatch):
    rows = [(1, prose(400, 1)), (2, prose(3000, 2)), (3, None), (4, "x")]
    monkeypatch.setattr(tokenbin, "BLOCK", 500)
    words = bpe.Vocabulary.read(bpe.VOCABULARY)

    class Sent:
        value = words

    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": pa.array([t for _, t in rows], pa.string())})
    monkeypatch.setattr(tokenbin.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 3})())
    blocks = [r for b in tokenbin._blocks(iter([batch]), Sent, "long", True) for r in b.to_pylist()]
    assert len(blocks) > 5 and all(r["round_trip"] and r["n_tokens"] <= 500 for r in blocks)
    back = [x for b in tokenbin._parts(iter([pa.RecordBatch.from_pylist(blocks)])) for x in b.to_pylist()]
    whole = {}
    for x in sorted(back, key=lambda x: x["block"]):
        whole[x["doc_id"]] = whole.get(x["doc_id"], []) + x["ids"]
    assert whole == {i: public.encode_ordinary(t or "") for i, t in rows}


def test_blocks_are_read_in_even_groups_whatever_batches_they_come_in(spark, monkeypatch):
    """What a worker holds is a group of blocks, not as many as a partition has."""
    ids = [np.arange(k, k + 40, dtype=np.int32) for k in range(23)]
    rows = [{"stream": 3, "block": k, "first_doc": 2 * k, "doc_ids": [k, None], "doc_tokens": [30, 10], "payload": p} for k, p in enumerate(tokenbin.encode_blocks(ids, 100))]
    sizes, decode = [], tokenbin.decode_blocks
    monkeypatch.setattr(tokenbin, "GROUP", 10)
    monkeypatch.setattr(tokenbin, "decode_blocks", lambda p: sizes.append(len(p)) or decode(p))
    kind = pa.schema([("stream", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("payload", pa.binary())])
    batches = [pa.RecordBatch.from_pylist(rows[a:b], kind) for a, b in ((0, 4), (4, 4), (4, 18), (18, 23))]
    got = [x for b in tokenbin._parts(iter(batches)) for x in b.to_pylist()]
    assert sizes == [10, 10, 3]
    want = [{"stream": 3, "number": 2 * k + j, "block": k, "doc_id": [k, None][j], "ids": ids[k][30 * j : 30 + 10 * j].tolist()} for k in range(23) for j in (0, 1)]
    assert got == want
    tokenbin.read_blocks(spark.createDataFrame([], tokenbin.BLOCKS))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(8 << 20)
