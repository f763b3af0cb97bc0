"""PII: generators propose overlapping spans, boosted trees score them, calibrated thresholds redact.

The generators are regular expressions of high recall, one or two for each kind; a phone, card or IBAN is
proposed from every group of digits or letters it may start at to every one it may end at, so that neighbours
hide nothing, and a secret of any length is proposed whole. Every candidate is described
by features of its format (digits, separators, check digits, entropy) and of its context (words and
characters around it); gradient-boosted trees turn them into a probability. Each kind has its own
threshold, calibrated on held-out rows. Of overlapping candidates above their thresholds the likelier
one stays, then the longer.

The trees are trained here, on rows that ``examples`` makes from a seed; no document is read for it.

All generators take time in proportion to the text: runs of a character class are taken whole, from their
beginning only, and numbers have a length that bounds them.

Defined results: null and empty texts hold nothing and stay as they are; a text, however long, is processed whole;
repeated rows are each treated alike; of two equally likely and equally long overlapping candidates the
first one stays, of two on the same span the last kind by name; an empty table gives no rows. ``find`` reads doc_id and text only, whatever
doc_id's type; ``redact_documents`` keeps all columns and, where there is an n_chars, sets it to the new
length of a text that it changed.
"""

from __future__ import annotations

import math
import random
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import fresh
from .textcol import TextBatch, arrow_column, modest_batches, segments, slices

KINDS = ("email", "phone", "ip", "card", "ssn", "iban", "secret")
_WORDISH = r"[^\W_]"
GENERATORS: list[tuple[str, re.Pattern]] = [
    ("email", re.compile(r"(?<![\w.+%\-])[\w.+%\-]++@[\w\-]++(?:\.[\w\-]++)*+")),
    ("phone", re.compile(r"(?=((?<![\w.])(?:\+|\(|\b)\(?\d(?:[ .()/\-]{0,3}\d){6,14}(?!\w)))")),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d)(?!\.\d)")),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){4,7}[0-9a-fA-F]{1,4}(?![\w:])")),
    ("card", re.compile(r"(?=((?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)))")),
    ("ssn", re.compile(r"(?=((?<![\d\-])\d{3}[\- ]\d{2}[\- ]\d{4}(?![\d\-])))")),
    ("iban", re.compile(r"(?=((?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?!\w)))")),
    ("secret", re.compile(r"(?<![^\s\"'=:(])[\w+/\-.]{8,}+(?!@)")),
    ("secret", re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|key|bearer|credential)s?[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;]{6,}+)")),
]
#: Digits (letters too in an IBAN) of a reading at least; readings start and end at any group of them.
_LEAST = {"phone": 7, "card": 13, "iban": 15}
_GROUP = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")
FEATURES = [f"is_{k}" for k in KINDS] + [
    "length", "digits", "digit_share", "letter_share", "upper_share", "separators", "luhn", "issuer", "octets", "iban_sum", "entropy", "plus", "bracket",
    "dotted_host", "hex", "before_phone", "before_card", "before_version", "before_secret", "before_record", "before_hash", "joined", "dates", "dots",
    "groups", "first_group", "last_group", "number_before", "number_after", "mark_before", "balanced", "dialled", "plus_before",
]
_BEFORE = [
    re.compile(r"(?i)\b(?:tel|phone|call|fax|mobile|cell|ring)"),
    re.compile(r"(?i)\b(?:card|visa|credit|payment|amex)"),
    re.compile(r"(?i)(?:\bversion|\brelease|\bv|\bsection|\bbuild|\bchapter|\bfirmware)[ :.#=]{0,2}$"),
    re.compile(r"(?i)(?:token|secret|passw|pwd|key|bearer|credential)\w*[\"']?\s{0,3}[:=]?\s{0,3}[\"']?$"),
    re.compile(r"(?i)\b(?:order|invoice|isbn|ticket|id|item|serial|ref|number|no|part|case|tracking)\W{0,3}$"),
    re.compile(r"(?i)\b(?:commit|sha\d*|md5|checksum|digest|hash|etag|uuid|file)\W{0,3}$"),
]
_DATE = re.compile(r"(?:19|20)\d\d[\-/.](?:0?[1-9]|1[0-2])[\-/.]")
_NUMBER_BEFORE = re.compile(r"\d[ .()/\-]{1,3}$")
_NUMBER_AFTER = re.compile(r"[ .()/\-]{1,3}\d")
_PLUS_BEFORE = re.compile(r"\+\d{1,3}[ .\-(]{0,2}$")
_DIALLED = re.compile(r"(?:(?:\+\d{1,3}|1)[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}|0\d(?:[ .\-]\d\d){4}|\+\d{1,3}(?:[ .\-]?\d){8,12}")
_ISSUER = re.compile(r"4|5[1-5]|2[2-7]|3[47]|36|30|6011|65")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def propose(text: str) -> list[tuple[int, int, str]]:
    """All candidates (start, end, kind); they may overlap."""
    found = set()
    for kind, pattern in GENERATORS:
        group = pattern.groups
        for m in pattern.finditer(text):
            a, b = m.span(group)
            while b > a and text[b - 1] in ".-!?#*$%&:)":
                b -= 1
            if b > a and (group or kind != "secret" or _DIGIT.search(text, a, b)):  # a bare secret holds a digit
                found.add((a, b, kind))
            if kind in _LEAST:  # another number or word may follow: every shorter reading too
                n, last = 0, a
                for part in _GROUP.finditer(text, a, b):
                    if n >= _LEAST[kind]:
                        found.add((a, last, kind))
                    n, last = n + part.end() - part.start(), part.end()
    return sorted(found)


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    s = text[start:end]
    before, after = text[max(0, start - 28) : start], text[end : end + 1]
    digits = re.sub(r"[^0-9]", "", s)
    letters = sum(c.isalpha() for c in s)
    n = len(s)
    counts: dict[str, int] = {}
    for c in s:
        counts[c] = counts.get(c, 0) + 1
    octets = s.split(".")
    groups = _GROUP.findall(s) or [""]
    return [
        *(float(kind == k) for k in KINDS),
        min(n, 100), min(len(digits), 40), len(digits) / n, letters / n, sum(c.isupper() for c in s) / n, sum(not c.isalnum() for c in s),
        float(13 <= len(digits) <= 19 and luhn(digits)), float(bool(_ISSUER.match(digits)) and len(digits) in ((15, 14) if digits[:1] == "3" else (16, 13, 19) if digits[:1] == "4" else (16,))),
        float(len(octets) == 4 and all(o.isdigit() and int(o) <= 255 and (o == "0" or o[0] != "0") for o in octets)), float(kind == "iban" and _iban_ok(s)),
        -sum(v / n * math.log2(v / n) for v in counts.values()), float(s[:1] == "+"), float("(" in s), float("@" in s and "." in s.rsplit("@", 1)[1].strip(".")),
        float(n >= 16 and all(c in "0123456789abcdefABCDEF" for c in s)), *(float(bool(p.search(before))) for p in _BEFORE),
        float(after.isalnum() or before[-1:].isalnum() or before[-1:] in ("$", "€", "£", ".")), float(bool(_DATE.search(s))), s.count("."),
        min(len(groups), 12), min(len(groups[0]), 40), min(len(groups[-1]), 40), float(bool(_NUMBER_BEFORE.search(before))), float(bool(_NUMBER_AFTER.match(text[end : end + 4]))),
        float(before[-1:] in ("-", "+", "(", "/")), float(s.count("(") == s.count(")")), float(bool(_DIALLED.fullmatch(s))), float(bool(_PLUS_BEFORE.search(before))),
    ]


class Trees:
    """Gradient-boosted regression trees for the log-odds of a binary label (Friedman's, with Newton leaves)."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.25, bins: int = 24):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], 1)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        out = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-out))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            splits = []
            for level in range(self.depth):
                width = 1 << level
                best = np.full(width, 1e-6)
                chosen = [(0, self.bins + 1)] * width
                for f in range(x.shape[1]):
                    key = node * (self.bins + 1) + code[:, f]
                    g = np.bincount(key, grad, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                    h = np.bincount(key, hess, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                    gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                    at = gain.argmax(1)
                    for k in np.flatnonzero(gain[np.arange(width), at] > best):
                        best[k], chosen[k] = gain[k, at[k]], (f, int(at[k]))
                splits.append(np.array(chosen))
                node = node * 2 + (code[np.arange(len(y)), splits[-1][node, 0]] > splits[-1][node, 1])
            g, h = np.bincount(node, grad, 1 << self.depth), np.bincount(node, hess, 1 << self.depth)
            leaves = self.rate * g / (h + 1)
            self.trees.append((splits, leaves))
            out += leaves[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        code = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], 1)
        out = np.full(len(x), self.base)
        for splits, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for s in splits:
                node = node * 2 + (code[np.arange(len(x)), s[node, 0]] > s[node, 1])
            out += leaves[node]
        return 1 / (1 + np.exp(-out))


def examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Made-up sentences with their spans of personal data; many hold only a look-alike."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "er", "in", "th", "de", "la", "on", "que", "sch", "ment", "ión", "st")) for _ in range(r.randint(1, 4)))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(k))

    def card(valid: bool) -> str:
        while True:
            s = r.choice(("4", "4", "51", "55", "53", "6011", "2221")) if valid or r.random() < 0.4 else r.choice("0123456789")
            s += d(16 - len(s))
            if luhn(s) == valid or (not valid and not _ISSUER.match(s)):
                break
        return s if r.random() < 0.6 else r.choice(" -").join(s[i : i + 4] for i in range(0, 16, 4))

    def iban() -> str:
        body = "".join(d(4) for _ in range(r.randint(3, 5)))
        land = r.choice(("DE", "FR", "ES", "GB", "NL"))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        s = f"{land}{check:02d}{body}"
        return s if r.random() < 0.6 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    jwt = lambda: f"eyJ{mixed(r.randint(15, 60))}.{mixed(r.randint(40, 600))}.{mixed(43)}"
    octet = lambda: str(r.randint(1, 255))
    makers = [
        ("email", lambda: f"{word()}{r.choice(('.', '_', '', '-'))}{r.choice((word(), d(2)))}@{word()}{r.choice(('', d(1)))}.{r.choice(('example.com', 'example.org', 'com', 'net', 'co.uk', 'de'))}", ""),
        ("phone", lambda: r.choice((f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{r.randint(30, 99)} {d(2)} {d(4)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{r.randint(10, 99)}{d(10)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}")), ""),
        ("phone", lambda: f"{d(3)} {d(3)} {d(4)}", "call "),
        ("ip", lambda: ".".join(octet() for _ in range(4)), ""),
        ("ip", lambda: ":".join(hexa(4) for _ in range(8)), ""),
        ("card", lambda: card(True), ""),
        ("card", lambda: card(True), "card number "),
        ("ssn", lambda: f"{r.randint(100, 899)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", ""),
        ("iban", iban, ""),
        ("secret", lambda: hexa(r.choice((32, 40, 64))), ("token", "secret", "api_key", "key", "TOKEN", "access_token")),
        ("secret", lambda: mixed(r.randint(10, 48)), ("password", "secret", "pwd", "token", "bearer", "auth_key")),
        ("secret", lambda: r.choice(("AKIA", "sk-", "ghp_")) + mixed(r.randint(16, 36)), ""),
        ("secret", lambda: mixed(r.randint(65, 900)), ("password", "secret", "key", "token", "api_key", "access_token")),
        ("secret", lambda: mixed(r.randint(65, 900)), "key "),
        ("secret", jwt, ("token", "secret", "bearer", "access_token")),
        ("secret", jwt, "token "),
        ("secret", jwt, "bearer "),
        (None, lambda: card(False), ""),
        (None, lambda: card(False), r.choice(("order ", "item ", "tracking "))),
        (None, lambda: r.choice((d(10), d(13), d(14), d(9), d(8))), ""),
        (None, lambda: f"{r.choice((19, 20))}{d(2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", ""),
        (None, lambda: f"{r.choice((19, 20))}{d(2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {r.randint(0, 23):02d}:{d(2)}", ""),
        (None, lambda: ".".join(str(r.randint(0, 30)) for _ in range(4)), r.choice(("version ", "release ", "v"))),
        (None, lambda: f"97{r.choice('89')}-{d(1)}-{d(4)}-{d(4)}-{d(1)}", "ISBN "),
        (None, lambda: f"{d(4)}-{d(4)}", ""),
        (None, lambda: f"{r.randint(1, 9)},{d(3)},{d(3)}", "$"),
        (None, lambda: f"{r.randint(1, 9)} {d(3)} {d(3)} {d(3)}", ""),
        (None, lambda: f"{d(6)}.{d(6)}", ""),
        (None, lambda: hexa(r.choice((32, 40, 64))), r.choice(("commit ", "sha1 ", "checksum ", "md5: "))),
        (None, lambda: ".".join(str(r.randint(256, 999)) for _ in range(4)), ""),
        (None, lambda: f"{word()}@{word()}", ""),
        (None, lambda: f"{word()}{d(2)}{word()}-{word()}", ""),
        (None, lambda: f"{word()}.{word()}/{word()}{d(1)}", ""),
        (None, lambda: mixed(r.randint(65, 900)), "image "),
        (None, lambda: "/".join(word() + d(1) for _ in range(r.randint(8, 60))), ""),
        (None, lambda: f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", "uuid "),
    ]
    out = []
    for k in range(n):
        kind, make, lead = makers[k % len(makers)]
        value = make()
        lead = f"{r.choice(lead)}{r.choice((' = ', '=', ': '))}{r.choice(('', chr(34)))}" if isinstance(lead, tuple) else lead
        head = " ".join(word() for _ in range(r.randint(0, 6)))
        head = (head + r.choice((" ", "\n", ". ", ", ")) if head else "") + lead
        tail = (chr(34) if head.endswith(chr(34)) else "") + r.choice(("", ".", ",", "###", "!!", " ")) + " " + " ".join(word() for _ in range(r.randint(0, 6)))
        more, also = "", None
        if kind != "secret" and not head.endswith(chr(34)) and r.random() < 0.1:  # another number follows
            more = r.choice((" ", ", "))
            also, value2 = r.choice(((None, d(4)), (None, d(2)), (None, word().upper()), (None, card(False)), ("card", card(True)), ("phone", f"{d(3)}-{d(3)}-{d(4)}"), ("ip", ".".join(octet() for _ in range(4))), ("phone", f"+1 ({d(3)}) {d(3)}-{d(4)}")))
        if r.random() < (0.3 if kind == "iban" else 0.08):
            head, value, tail = head.upper(), value.upper(), (" " if kind == "iban" and r.random() < 0.5 else "") + tail.upper()
        spans = []
        if kind in ("phone", "card", "iban") and r.random() < 0.25 or not kind and value[:1].isdigit() and not lead and r.random() < 0.1:  # a number or an upper-case word stands before
            front, first = r.choice(((None, d(2)), (None, d(1)), (None, str(r.randint(1950, 2030))), (None, word().upper()), ("phone", f"{d(3)}-{d(3)}-{d(4)}"), ("phone", f"({d(3)}) {d(3)}-{d(4)}"), ("card", card(True))))
            spans += [(len(head), len(head) + len(first), front)] if front else []
            head += first + " "
        spans += [(len(head), len(head) + len(value), kind)] if kind else []
        text = head + value + more
        if more:
            spans += [(len(text), len(text) + len(value2), also)] if also else []
            text += value2
        out.append((text + tail, spans))
    return out


def candidates(rows: list[tuple[str, list[tuple[int, int, str]]]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features, labels and kinds of everything proposed on made-up rows; only a right span of the right kind is positive."""
    x, y, kinds = [], [], []
    for text, spans in rows:
        for a, b, k in propose(text):
            x.append(features(text, a, b, k))
            y.append(float((a, b, k) in spans))
            kinds.append(k)
    return np.array(x), np.array(y), kinds


def train(n: int = 10000, seed: int = 7, precision: float = 0.98) -> dict:
    """Trees on ``n`` made-up rows; each kind's threshold is the lowest that has this precision on as many held-out ones."""
    x, y, _ = candidates(examples(n, seed))
    trees = Trees().fit(x, y)
    x, y, kinds = candidates(examples(n, seed + 1))
    p, kinds = trees.predict(x), np.array(kinds)
    limits = {}
    for kind in KINDS:
        own, hit = p[kinds == kind], y[kinds == kind]
        order = np.argsort(-own, kind="stable")
        right = np.cumsum(hit[order]) / np.arange(1, len(order) + 1)
        ok = np.flatnonzero(right >= precision)
        limits[kind] = float(min(0.9, max(0.2, own[order][ok[-1]]))) if len(ok) else 0.9
    return {"trees": trees, "limits": limits}


def detect_all(texts: list[str], model: dict) -> list[list[tuple[int, int, str, float]]]:
    """The redactions of each text: (start, end, kind, probability), ascending, without overlap."""
    proposed = [propose(t) for t in texts]
    flat = [features(t, *s) for t, spans in zip(texts, proposed) for s in spans]
    p = model["trees"].predict(np.array(flat)).tolist() if flat else []
    out, at = [], 0
    for spans in proposed:
        own = p[at : at + len(spans)]
        at += len(spans)
        likely = sorted(((round(q, 4), b - a, -a, k) for (a, b, k), q in zip(spans, own) if q >= model["limits"][k]), reverse=True)
        taken: list[tuple[int, int, str, float]] = []  # ascending, without overlap
        for q, n, a, k in likely:
            a = -a
            i = bisect_left(taken, (a,))
            if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or a + n <= taken[i][0]):
                taken.insert(i, (a, a + n, k, q))
        out.append(taken)
    return out


def detect(text: str, model: dict) -> list[tuple[int, int, str, float]]:
    """The redactions of one text."""
    return detect_all([text], model)[0]


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    out, at = [], 0
    for a, b, kind, _ in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


FOUND = "spans array<struct<start:int,end:int,kind:string,score:double>>, redacted string"
_FOUND = pa.struct([("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))), ("redacted", pa.string())])
_MODELS: dict[str, dict] = {}
#: Every candidate of every generator holds one of these bytes or follows one.
_MARKS = np.zeros(256, bool)
_MARKS[[*range(48, 58), ord("@"), ord("="), ord(":")]] = True


def _scan(text: pa.Array, sent, key: str) -> list[dict | None]:
    """What each text holds; None where nothing is found."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = sent.value
    out: list[dict | None] = []
    for part in slices(text):
        batch = TextBatch(part)
        rows, begin = segments(batch.off)
        marked = rows[np.logical_or.reduceat(_MARKS[batch.data], begin)] if len(rows) else rows
        own: list[dict | None] = [None] * batch.n
        texts = [part[row].as_py() or "" for row in marked.tolist()]
        for row, t, spans in zip(marked.tolist(), texts, detect_all(texts, _MODELS[key])):
            if spans:
                own[row] = {"spans": [dict(zip(("start", "end", "kind", "score"), s)) for s in spans], "redacted": redact(t, spans)}
        out += own
    return out


def _redacted(text: pa.Array, sent, key: str) -> pa.Array:
    return pa.array((x and x["redacted"] for x in _scan(text, sent, key)), pa.string())


def _hits(batches: Iterator[pa.RecordBatch], sent, key: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = _scan(b.column("text"), sent, key)
        rows = [k for k, x in enumerate(found) if x]
        if rows:
            own = pa.array([found[k] for k in rows], _FOUND)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), own.field("spans"), own.field("redacted")], ["doc_id", "spans", "redacted"])


def _send(docs: DataFrame, model: dict | None) -> tuple:
    return docs.sparkSession.sparkContext.broadcast(model or train()), uuid.uuid4().hex


def find(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """One row for each document with personal data: doc_id, spans (characters, kind, score), redacted text."""
    modest_batches(docs.sparkSession)
    sent, key = _send(docs, model)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(FOUND).fields])
    return docs.select("doc_id", "text").mapInArrow(lambda it: _hits(it, sent, key), schema)


def redact_documents(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """The documents with all their columns, redacted; n_chars, where it exists, counts the new text."""
    flag = fresh("__pii", docs.columns)
    text = F.coalesce(F.col(flag), F.col("text"))
    out = docs.withColumn(flag, arrow_column(_redacted, "string", *_send(docs, model))(F.col("text")))
    changed = {"text": text} | ({"n_chars": F.when(F.col(flag).isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    return out.withColumns(changed).select(docs.columns)
