"""The byte-array view of text columns against plain string code."""

import re
import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfold.llm.textcol import TextBatch, range_hash, shingles, slices

text = st.lists(st.one_of(st.none(), st.text(alphabet="aBz09 .,\nÉéñßΣПривет東京アกิ’—  ؟。Ⅻ۴\u0301🙂'-", max_size=30)), max_size=12)


def fold(c):
    small = c.lower()
    return small if len(small) == 1 and len(small.encode()) == len(c.encode()) and unicodedata.category(c)[0] == "L" else c


def word_spans(s):
    """(word, start, end) by plain string code: runs of letters, marks and digits, but Han, kana and Thai characters alone."""
    out, own, start = [], "", 0
    for k, c in enumerate([*(s or ""), " "]):
        inside = unicodedata.category(c)[0] in "LMN"
        alone = inside and re.match(r"[\u0e00-\u0e7f\u3040-\u30ff\u4e00-\u9fff]", c)
        if own and (alone or not inside):
            out.append((own, start, k))
            own = ""
        if alone:
            out.append((c, k, k + 1))
        elif inside:
            start = start if own else k
            own += fold(c)
    return out


def words_of(s):
    return [w for w, *_ in word_spans(s)]


@settings(max_examples=150, deadline=None)
@given(text)
def test_words_and_normal_form(column):
    b = TextBatch(pa.array(column, pa.string()))
    starts, ends, first = b.words
    raw = b.folded.tobytes()
    out, place, begin = b.normalized()
    for i, s in enumerate(column):
        want = words_of(s)
        assert [raw[x:y].decode() for x, y in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])] == want
        assert out[begin[i] : begin[i + 1]].tobytes().decode() == "".join(w + " " for w in want)
        for x in starts[first[i] : first[i + 1]]:
            assert s[b.char_at(i, x)].encode()[0] == b.data[x]


@settings(max_examples=100, deadline=None)
@given(text, st.integers(1, 40))
def test_slices_keep_rows(column, limit):
    got = [x for part in slices(pa.array(column, pa.string()), limit) for x in part.to_pylist()]
    assert got == column


def test_hash_depends_on_bytes_only_and_chunks_do_not_matter():
    data = np.frombuffer(b"abcXabcYYabc", np.uint8)
    s, e = np.array([0, 4, 9]), np.array([3, 7, 12])
    a, b = range_hash(data, s, e), range_hash(data, s, e, limit=4)
    assert len(set(a.tolist())) == 1 and (a == b).all()
    assert len(set(range_hash(data, np.array([0, 3, 7]), np.array([3, 4, 8])).tolist())) == 3


def test_shingles_of_short_and_long_texts():
    b = TextBatch(pa.array(["a b c d", "", None, "a b", "b c d", "a"]))
    own, begin = shingles(b.word_hashes(), b.words[2], 3)
    assert np.diff(begin).tolist() == [2, 0, 0, 1, 1, 1]
    assert own[1] == own[3] and len(set(own.tolist())) == 4


def test_punctuation_and_case_of_all_scripts():
    column = ["It’s “good” — now", "it's good now", "ПРИВЕТ, МИР", "привет мир", "東京。大阪", "東京大阪"]
    b = TextBatch(pa.array(column))
    out, _, begin = b.normalized()
    got = [out[x:y].tobytes().decode() for x, y in zip(begin, begin[1:])]
    assert got[0] == got[1] == "it s good now " and got[2] == got[3] == "привет мир " and got[4] == got[5] == "東 京 大 阪 "
