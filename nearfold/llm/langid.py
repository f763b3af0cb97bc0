"""Language identification: script ranges narrow candidates, Viterbi over word scores labels spans.

Every word is scored for every language with byte trigrams. The script of its first character narrows
the languages that may claim it to those that use the script in the training rows. Against them competes
``und`` with a floor that every trigram would have to better: the floor is what the labelled rows themselves
reach, all but the lowest ``LOW`` of them, less ``SLACK`` nats a trigram. So text of other languages, and junk in a
known script, is ``und``. The best path through the words, where each change of language costs
``SWITCH`` (and so does beginning with ``und``), gives the spans. Words without letters say nothing.

A text in which one language's path can't be bettered by any detour (no run of words gains more than
one change costs, by a bound over all languages) gets that path at once; for all others the Viterbi
recursion runs. Both give the same best path.

Defined results: null texts, empty texts and texts without words are ``und`` with no spans, texts of words without
letters ``und`` with one; very long texts are labelled whole; null or empty labels are not trained on; with no
labelled row at all every text is ``und``; ties go to the first language by name, ``und`` last; repeated rows are
labelled each; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh, materialize, release
from .textcol import LETTER, TextBatch, arrow_column, modest_batches, segments, slices

#: Cost of a change of language, in nats.
SWITCH = 12.0
#: The most labelled rows the model is fitted to, drawn by a hash of doc_id from the whole table.
FIT_ROWS = 4000
#: A text of which less than this share of words is in any known language is rejected.
LEAST_KNOWN = 0.5
#: A language is a candidate for a script that makes up this share of its training words.
SCRIPT_SHARE = 0.01
BITS = 16
UND = "und"
SHUT = np.float32(-50.0)
#: The share of labelled rows that may lie below the floor of ``und``, and nats a trigram from there down to it.
LOW, SLACK = 0.001, 1.5
#: Trigrams of a labelled row that counts for the floor, at least.
LEAST_TRIGRAMS = 30
#: What a word without letters scores as ``und``: enough to decide between nothing and nothing.
HINT = np.float32(0.01)

LABEL = "struct<lang:string,share:double,spans:array<struct<start:int,end:int,lang:string>>>"
_LABEL = pa.struct([("lang", pa.string()), ("share", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))])

SCRIPTS = ("Latin", "Greek", "Cyrillic", "Hebrew", "Arabic", "Indic", "Thai", "Kana", "Han", "Hangul", "Other")
_SCRIPT = np.full(1 << 16, 10, np.uint8)  # by the first two bytes of a word
for _lead, _name in (
    *((b, 0) for b in range(0x00, 0x80)),
    *((b, 0) for b in range(0xC2, 0xCA)),
    *((b, 1) for b in (0xCD, 0xCE, 0xCF)),
    *((b, 2) for b in range(0xD0, 0xD4)),
    *((b, 3) for b in (0xD6, 0xD7)),
    *((b, 4) for b in range(0xD8, 0xDC)),
    *((b, 8) for b in range(0xE4, 0xEA)),
    *((b, 9) for b in range(0xEA, 0xEE)),
):
    _SCRIPT[_lead << 8 : (_lead << 8) + 256] = _name
for _second in range(0x80, 0xC0):
    _SCRIPT[(0xE0 << 8) + _second] = 6 if _second in (0xB8, 0xB9) else 5
    _SCRIPT[(0xE1 << 8) + _second] = 0 if _second in (0xB8, 0xB9, 0xBA, 0xBB) else 1 if _second in (0xBC, 0xBD, 0xBE, 0xBF) else 10
    _SCRIPT[(0xE3 << 8) + _second] = 7 if _second in (0x81, 0x82, 0x83) else 8 if _second >= 0x90 else 10


def _units(batch: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram codes of the normalised bytes (0: not counted), where each word's begin, each text's first word,
    each word's script and whether it has letters."""
    out, _, _ = batch.normalized()
    starts, ends, word_first = batch.words
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), word_first, np.zeros(0, np.uint8), np.zeros(0, bool)
    around = np.concatenate(([32], out, [32])).astype(np.uint32)
    code = (around[:-2] * np.uint32(0x9E3779B1)) ^ (around[1:-1] * np.uint32(0x85EBCA6B)) ^ (around[2:] * np.uint32(0xC2B2AE35))
    code = (code * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
    code[out == 32] = 0  # a blank's own trigram would depend on the next word, or the next text
    lettered = (np.bitwise_or.reduceat(batch.flags, starts) & LETTER) > 0
    size = ends - starts + 1
    code[np.repeat(~lettered, size)] = 0
    script = _SCRIPT[(batch.data[starts].astype(np.uint32) << 8) | batch.data[starts + 1]]
    return code, np.cumsum(size) - size, word_first, script, lettered


def counts(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How often each trigram, and each script among lettered words, stands in a slice of texts."""
    code, _, _, script, lettered = _units(TextBatch(part))
    table = np.bincount(code, minlength=1 << BITS)
    table[0] = 0
    return table, np.bincount(script[lettered], minlength=len(SCRIPTS))


def model_of(langs: list[str], table: np.ndarray, script: np.ndarray) -> dict:
    """A model, as yet without a floor, from counts: trigrams x languages, scripts x languages."""
    smooth = table + 0.1
    log = np.log(smooth / smooth.sum(0))
    usual = (table * log).sum(0) / np.maximum(table.sum(0), 1)  # of a trigram of the language itself
    allowed = script / np.maximum(script.sum(0), 1) >= SCRIPT_SHARE
    shut = np.zeros((len(SCRIPTS), len(langs) + 1))
    shut[:, :-1][~allowed] = SHUT
    return {"langs": [*langs, UND], "log": log, "usual": usual, "shut": shut.astype(np.float32)}


def reached(part: pa.Array, langs: list[str], model: dict) -> np.ndarray:
    """How far each text's mean trigram lies above what its language's usually has (NaN: too few, or no such language)."""
    batch = TextBatch(part)
    code, begins, first, _, _ = _units(batch)
    out = np.full(batch.n, np.nan)
    edge = np.append(begins, len(code))[first]
    for row, lang in enumerate(langs):
        own = code[edge[row] : edge[row + 1]]
        own = own[own > 0]
        if len(own) >= LEAST_TRIGRAMS and lang in model["langs"][:-1]:
            k = model["langs"].index(lang)
            out[row] = model["log"][own, k].mean() - model["usual"][k]
    return out


def finish(model: dict, low: float) -> dict:
    """The model with the floor that follows from the labelled rows' ``low`` end."""
    floor = (model["usual"].min() if len(model["usual"]) else 0.0) + min(low, 0.0) - SLACK
    scores = (model["log"] - floor).astype(np.float32)
    scores[0] = 0
    return {"langs": model["langs"], "columns": list(np.ascontiguousarray(scores.T)), "shut": model["shut"]}


def train(rows: list[tuple[str, str]]) -> dict:
    """A model from (language, text) rows."""
    langs = sorted({lang for lang, _ in rows})
    table, script = np.zeros((1 << BITS, len(langs))), np.zeros((len(SCRIPTS), len(langs)))
    for k, lang in enumerate(langs):
        for part in slices(pa.array([t for x, t in rows if x == lang])):
            a, b = counts(part)
            table[:, k] += a
            script[:, k] += b
    model = model_of(langs, table, script)
    far = [x for lang, t in rows for part in slices(pa.array([t])) for x in reached(part, [lang], model).tolist() if x == x]
    return finish(model, float(np.quantile(far, LOW)) if far else 0.0)


def word_scores(batch: TextBatch, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Scores, words x languages, and each text's first word."""
    code, begins, first, script, lettered = _units(batch)
    if not len(begins):
        return np.zeros((0, len(model["langs"])), np.float32), first
    score = model["shut"][script]
    for k in range(score.shape[1] - 1):  # und scores nothing
        score[:, k] += np.add.reduceat(model["columns"][k][code], begins)
    score[~lettered] = 0
    score[~lettered, -1] = HINT
    rows, begin = segments(first)
    some = np.add.reduceat(lettered.astype(np.int64), begin) > 0
    score[begin[some], -1] -= np.float32(SWITCH)
    return score, first


def viterbi(score: np.ndarray, switch: float) -> np.ndarray:
    """The best path through words x languages scores where each change costs ``switch``; ties to the lower index."""
    n, width = score.shape
    came = np.empty((n, width), np.int8)
    stay = np.arange(width)
    v = score[0].tolist()
    for t, s in enumerate(score.tolist()):
        if t == 0:
            came[0] = stay
            continue
        top = max(v)
        lead = v.index(top)
        floor = top - switch
        back = [k if x >= floor else lead for k, x in enumerate(v)]
        v = [(x if x >= floor else floor) + y for x, y in zip(v, s)]
        came[t] = back
    path = np.empty(n, np.int64)
    k = v.index(max(v))
    for t in range(n - 1, -1, -1):
        path[t] = k
        k = came[t, k]
    return path


def label(column: pa.Array, model: dict, switch: float = SWITCH) -> list[dict]:
    """What ``LABEL`` says, of every text."""
    langs = model["langs"]
    und = len(langs) - 1
    found: list[dict] = []
    for part in slices(column):
        batch = TextBatch(part)
        score, first = word_scores(batch, model)
        rows, begin = segments(first)
        result = [{"lang": UND, "share": 0.0, "spans": []} for _ in range(batch.n)]
        if len(rows):
            starts, ends, _ = batch.words
            size = np.diff(np.concatenate((begin, [len(score)])))
            best = np.add.reduceat(score.astype(np.float64), begin, axis=0).argmax(1)
            own = np.repeat(best, size)
            at = np.arange(len(score))
            lead = score[at, own].astype(np.float64)
            score_else = score.copy()
            score_else[at, own] = -np.inf
            gain = score_else.max(1) - lead if len(langs) > 1 else np.full(len(score), -1.0)
            # The largest gain of any run of words of a text: prefix sums less their running minimum, text by text.
            apart = np.repeat(np.arange(len(rows)) * (2 * np.abs(gain).sum() + 1), size)
            total = np.cumsum(gain)
            reach = (total - apart) - np.minimum.accumulate(total - gain - apart)
            settled = np.maximum.reduceat(reach, begin) <= switch
            for k, row in enumerate(rows.tolist()):
                lo, hi = int(begin[k]), int(begin[k] + size[k])
                if settled[k]:
                    cuts, tags, counts = [lo, hi], [int(best[k])], None
                else:
                    path = viterbi(score[lo:hi], switch)
                    change = np.flatnonzero(np.diff(path)) + 1
                    cuts = [lo, *(lo + change).tolist(), hi]
                    tags = path[np.concatenate(([0], change))].tolist()
                    counts = np.bincount(path, minlength=len(langs))
                known = None if counts is None else counts[:und]
                if known is None:
                    lang, share = (langs[tags[0]], 0.0 if tags[0] == und else 1.0)
                else:
                    top = int(known.argmax()) if und else und
                    lang, share = (langs[top], float(known[top] / (hi - lo))) if known.sum() >= LEAST_KNOWN * (hi - lo) and und else (UND, 0.0)
                if len(tags) == 1:
                    spans = [{"start": batch.char_at(row, int(starts[lo])), "end": batch.char_at(row, int(ends[hi - 1])), "lang": langs[tags[0]]}]
                else:
                    a0 = int(batch.off[row])
                    chars = np.concatenate(([0], np.cumsum((batch.data[a0 : int(batch.off[row + 1])] & 0xC0) != 0x80)))
                    spans = [{"start": int(chars[starts[a] - a0]), "end": int(chars[ends[b - 1] - a0]), "lang": langs[t]} for a, b, t in zip(cuts, cuts[1:], tags)]
                result[row] = {"lang": lang, "share": share, "spans": spans}
        found += result
    return found


_MODELS: dict[str, dict] = {}


def _label(text: pa.Array, sent, key: str, switch: float) -> pa.Array:
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = sent.value
    return pa.array(label(text, _MODELS[key], switch), _LABEL)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, n): trigrams, and from 1 << BITS on scripts, of a partition."""
    found: dict[str, np.ndarray] = {}
    for b in batches:
        for lang in b.column("lang").unique().to_pylist():
            own = found.setdefault(lang, np.zeros((1 << BITS) + len(SCRIPTS), np.int64))
            for part in slices(b.column("text").filter(pc.equal(b.column("lang"), lang))):
                table, script = counts(part)
                own[: 1 << BITS] += table
                own[1 << BITS :] += script
    for lang, own in found.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "code", "n"])


def _reached(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = 0
        for part in slices(b.column("text")):
            far = reached(part, b.column("lang").slice(at, len(part)).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(far[~np.isnan(far)])], ["x"])
            at += len(part)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """A model of ``docs.lang`` from about ``fit_rows`` rows, drawn by a hash of doc_id; whole texts are read.

    The rows stay on the executors: the driver gets their trigram counts, at most 65,536 for each label, and a quantile.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    labelled = docs.filter("lang IS NOT NULL AND lang <> '' AND doc_id IS NOT NULL")
    share = min(1.0, fit_rows / max(1, labelled.select(F.lit(1)).count()))
    drawn = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
    drawn = materialize(drawn.filter("text IS NOT NULL").select("lang", "text"))
    found = drawn.mapInArrow(_counted, "lang string, code int, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found.lang.unique())
    table = np.zeros(((1 << BITS) + len(SCRIPTS), len(langs)))
    for k, lang in enumerate(langs):
        own = found[found.lang == lang]
        table[own.code.to_numpy(), k] = own.n.to_numpy()
    model = model_of(langs, table[: 1 << BITS], table[1 << BITS :])
    sent = spark.sparkContext.broadcast(model)
    low = drawn.mapInArrow(lambda it: _reached(it, sent), "x double").agg(F.percentile("x", F.lit(LOW))).first()[0]
    release(drawn)
    return finish(model, low or 0.0)


def label_column(model: dict, docs: DataFrame, text: Column, switch: float = SWITCH) -> Column:
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_column(_label, LABEL, sent, uuid.uuid4().hex, switch)(text)


def identify(docs: DataFrame, model: dict | None = None, switch: float = SWITCH) -> DataFrame:
    """One row for each document: doc_id, lang, share of its words, spans (character offsets, language)."""
    model = model or fit(docs)
    return docs.select("doc_id", label_column(model, docs, F.col("text"), switch).alias("x")).select("doc_id", "x.*")


def keep_identified(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """The documents, with all their columns, whose language is known; ``und`` is rejected."""
    model = model or fit(docs)
    flag = fresh("__lang", docs.columns)
    return docs.withColumn(flag, label_column(model, docs, F.col("text")).getField("lang")).filter(F.col(flag) != UND).drop(flag)
