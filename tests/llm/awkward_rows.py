"""Small inputs with everything that could trip an operator."""

#: Names that operators use inside, as columns of the input.
CLASHING = ("node", "key", "h", "sketch", "a", "b", "c", "x", "m", "label", "item_id", "start", "end", "spans", "redacted", "token_ids", "fingerprint", "docs", "file", "seq", "pattern", "since", "hit", "begins", "__LANG", "__Hits", "__PII", "__key", "__Mark", "t", "head", "group", "phrases")

WORDS = "the of and to in for that with from this are was onion river market window letter garden stone bridge yellow quiet engine winter paper forest silver".split()


def prose(n, seed):
    import random

    r = random.Random(seed)
    out = [r.choice(WORDS) + r.choice(("", "", "ing", "ed", "s", "ly")) for _ in range(n)]
    return " ".join(out) + "."


def awkward_rows():
    """(doc_id, text, lang, source, n_chars): nulls, empties, a very long text, ties, repeated rows."""
    base = prose(120, 1)
    words = base.split()
    near = words[:30] + ["changed"] + words[31:]
    rows = [
        (1, base, "en", "s0"), (2, base, "en", "s1"), (3, " ".join(near), "en", None), (4, base.upper().replace(" ", "  "), None, "s0"),
        (5, None, "en", "s0"), (6, "", "en", "s0"), (7, " \n\t ", None, None), (8, "?!... --", "en", "s0"), (9, "x", "en", "s0"), (10, "x", "en", "s0"),
        (11, prose(60000, 2) + " mail me@example.com " + base, "en", "s0"), (12, prose(200, 3), "en", "s0"), (12, prose(200, 3), "en", "s0"), (None, prose(80, 4), "en", "s0"), (None, None, None, None),
        (13, "Überraschung ÉTÉ año 東京 привет 🙂 " + prose(40, 5), "de", "s2"), (14, "y" * 300000, "en", "s0"), (15, prose(70, 6) + " " + base, "en", "s0"), (16, prose(49, 7), "en", "s0"), (17, prose(49, 7), "en", "s0"),
    ]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
