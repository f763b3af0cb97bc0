"""MinHash groups, SimHash pairs, repeated passages and components against brute force."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from awkward_rows import awkward_rows, prose
from nearfold.llm import minhash, simhash, substring
from nearfold.llm.components import components
from nearfold.llm.textcol import TextBatch
from test_text import word_spans, words_of


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def shingle_sets(rows):
    """Word 3-grams by plain string code; all words where there are fewer."""
    out = []
    for _, t in rows:
        w = words_of(t)
        out.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    return out


def groups_by_force(rows, threshold=minhash.THRESHOLD):
    sets, up = shingle_sets(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    out = defaultdict(set)
    for i, (doc, _) in enumerate(rows):
        out[root(i)].add(doc)
    return {frozenset(g) for g in out.values() if len(g) > 1}


def groups_of(result):
    out = defaultdict(set)
    for r in result.collect():
        out[r.duplicate_of] |= {r.duplicate_of, r.doc_id}
        assert r.doc_id > r.duplicate_of
    return {frozenset(g) for g in out.values()}


def test_minhash_finds_the_groups(spark, documents):
    assert groups_of(minhash.duplicates(documents)) == groups_by_force(rows_of(documents))


def test_minhash_many_copies_and_bridges(spark):
    base = prose(100, 1).split()
    rows = [(i, " ".join(base[:k] + [f"edit{i}"] + base[k + 1 :])) for i, k in enumerate([5 * (i % 19) for i in range(60)])]
    rows += [(100 + i, prose(90, 50 + i)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert groups_of(minhash.duplicates(df)) == groups_by_force(rows)


def test_minhash_awkward(spark, awkward, empty):
    rows = sorted({(i, t) for i, t, *_ in awkward_rows() if i is not None and t is not None})
    assert groups_of(minhash.duplicates(awkward)) == groups_by_force(rows)
    assert {1, 2, 4} <= next(g for g in groups_by_force(rows) if 1 in g)
    kept = minhash.drop_duplicates(awkward)
    assert kept.columns == awkward.columns
    left = [r.doc_id for r in kept.select("doc_id").collect()]
    gone = {r.doc_id for r in minhash.duplicates(awkward).collect()}
    assert sorted(x for x in left if x is not None) == sorted({i for i, *_ in awkward_rows() if i is not None} - gone)
    assert left.count(None) == 2
    assert minhash.duplicates(empty).count() == 0 and minhash.drop_duplicates(empty).count() == 0


def test_every_text_of_a_repeated_id_is_compared(spark):
    w, u, x = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(1, w), (2, w), (2, u), (3, x), (3, x), (3, x + " and more"), (4, u.upper()), (None, w), (5, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted(tuple(r) for r in minhash.duplicates(df).collect())
    assert found == [(2, 1, 2), (4, 2, 2)]
    kept = sorted(((r.doc_id, r.text) for r in minhash.drop_duplicates(df).collect()), key=str)
    three = [t for i, t in kept if i == 3]
    assert len(three) == 1 and three[0] in (x, x + " and more")
    assert [r for r in kept if r[0] != 3] == sorted([(1, w), (2, u), (None, w), (5, None)], key=str)


def test_ids_that_are_no_numbers(spark):
    df = spark.createDataFrame([("1", prose(60, 1)), ("02", prose(60, 1)), ("x", prose(60, 1)), ("x", prose(60, 2))], "doc_id string, text string")
    assert [tuple(r) for r in minhash.duplicates(df).collect()] == [(2, 1, 2)]
    assert sorted(r.doc_id for r in minhash.drop_duplicates(df).collect()) == ["1", "x", "x"]
    assert {r.doc_id for r in substring.repeated_passages(df).collect()} == {1, 2}
    assert [(r.doc_a, r.doc_b) for r in simhash.near_documents(df).collect()] == [(1, 2)]


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 6000).astype(np.uint64)
    for shared in (0, 300, 900):
        a, b = pool[:1000], pool[1000 - shared : 2000 - shared]
        k = minhash.registers(np.concatenate((a, b)), np.array([0, 1000]), 512)
        union = minhash.registers(np.unique(np.concatenate((a, b))), np.array([0]), 512)
        assert (minhash.merge(k[0], k[1]) == union[0]).all()
        want = shared / (2000 - shared)
        assert abs(minhash.similarity(k[:1], k[1:])[0] - want) < 0.08
        assert abs(minhash.cardinality(union)[0] / (2000 - shared) - 1) < 0.2


def test_band_recall():
    """Of pairs at the threshold, nine in ten share a band."""
    r = np.random.default_rng(2)
    hit, n = 0, 600
    for _ in range(n):
        pool = r.integers(0, 2**63, 300).astype(np.uint64)
        a, b = pool[:225], pool[75:]  # similarity 1/2
        k = minhash.registers(np.concatenate((a, b)), np.array([0, 225]))
        keys = minhash._bands(pa.array([x.astype("<u2").tobytes() for x in k], pa.binary()))
        hit += bool((keys[0] == keys[1]).any())
    assert hit / n > 0.89


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(5, 1), (1, 5), (7, 7), (9, 8), (None, 3)], [(0, i) for i in range(1, 30)] + [(50, 51)], []])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert got == {x: root(x) for x in list(up)}


def near_by_force(rows, radius):
    found, prints = simhash.fingerprints_of(pa.array([t for _, t in rows], pa.string()))
    by = defaultdict(set)
    for i, f in zip(found.tolist(), prints.tolist()):
        if rows[i][0] is not None:
            by[f].add(rows[i][0])
    out = {(min(v), x, 0) for v in by.values() for x in v if x != min(v)}
    keys = sorted(by)
    for i, f in enumerate(keys):
        for g in keys[:i]:
            d = (f ^ g).bit_count()
            if d <= radius:
                out.add((*sorted((min(by[f]), min(by[g]))), d))
    return out


@pytest.mark.parametrize("radius,blocks", [(3, 6), (6, 9), (0, 2)])
def test_simhash_pairs(spark, documents, radius, blocks):
    got = [tuple(r) for r in simhash.near_documents(documents, radius, blocks).collect()]
    assert len(got) == len(set(got)) and set(got) == near_by_force(rows_of(documents), radius)


def test_simhash_awkward(spark, awkward, empty):
    rows = [(i, t) for i, t, *_ in awkward_rows()]
    got = [tuple(r) for r in simhash.near_documents(awkward).collect()]
    assert len(got) == len(set(got)) and set(got) == near_by_force(rows, simhash.RADIUS)
    assert simhash.near_documents(empty).count() == 0


def test_fingerprints_by_plain_votes(texts):
    def mix(x):
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * odd % 2**64
        return x ^ (x >> 31)

    own = list(texts.values())[:40]
    rows, prints = simhash.fingerprints_of(pa.array(own))
    for row, got in zip(rows.tolist(), prints.tolist()):
        votes = [0] * 64
        for w in set(words_of(own[row])):
            h = mix(int(TextBatch(pa.array([w])).word_hashes()[0]))
            votes = [v + (1 if h >> (63 - k) & 1 else -1) for k, v in enumerate(votes)]
        assert got == sum(1 << (63 - k) for k, v in enumerate(votes) if v > 0)


def test_simhash_terms_vote_with_their_weights(spark):
    """Weights by plain code: counts within a text, and how many of all the texts have the word."""
    import math
    from collections import Counter

    def mix(x):
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * odd % 2**64
        return x ^ (x >> 31)

    rows = [(k, prose(20 + 7 * k, k) + f" rare{k}" * (1 + k % 5)) for k in range(90)] + [(90, prose(40, 1)), (90, prose(40, 1)), (91, "the the the onion"), (None, "Onion"), (92, None), (93, "?")]
    own = [(i, Counter(words_of(t))) for i, t in rows if t and words_of(t)]
    seen = Counter(w for _, c in own for w in c)
    want = Counter()
    for i, c in own:
        votes = [0] * 64
        for w, n in c.items():
            h, weight = mix(int(TextBatch(pa.array([w])).word_hashes()[0])), round(16 * (1 + math.log(n)) * math.log2(1 + min(len(own) / seen[w], 32)))
            votes = [v + (weight if h >> (63 - k) & 1 else -weight) for k, v in enumerate(votes)]
        want[i, sum(1 << (63 - k) for k, v in enumerate(votes) if v > 0)] += 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter((r.doc_id, r.fingerprint % 2**64) for r in simhash.fingerprints(df, weighted=True).collect())
    assert got == want
    assert simhash.fingerprints(df.limit(0), weighted=True).count() == 0


def test_simhash_weighted_recall(spark):
    """Copies with some words replaced are found, and texts that only share frequent words are not."""
    r = np.random.default_rng(6)
    common, pool = [f"c{k}" for k in range(20)], [f"w{k}" for k in range(4000)]
    rows = []
    for k in range(150):
        base = r.choice(common, 150).tolist() + r.choice(pool, 150).tolist()
        copy = list(base)
        for at in r.choice(300, int(r.integers(1, 20)), replace=False):
            copy[at] = str(r.choice(pool)) + "x"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    got = {(x.doc_a, x.doc_b) for x in simhash.near_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), weighted=True).collect()}
    planted = {(2 * k, 2 * k + 1) for k in range(150)}
    assert len(got & planted) >= 0.9 * len(planted) and len(got - planted) < 0.001 * len(rows) ** 2 / 2


def test_simhash_votes():
    rows, prints = simhash.fingerprints_of(pa.array(["one two three four", "ONE, two\nthree four!", "", None, "one"]))
    assert rows.tolist() == [0, 1, 4] and prints[0] == prints[1]


def test_simhash_blocks_leave_no_pair_out():
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 40).astype(np.uint64)
    near = np.concatenate([base] + [base ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (k, 40)).astype(np.uint64)) for k in range(1, 16)])
    for radius, blocks in ((simhash.RADIUS, simhash.BLOCKS), (10, 3), (8, 4), (3, 6), (5, 2)):
        i, j = simhash.pairs_within(near, near, radius, blocks)
        want = np.argwhere(np.bitwise_count(near[:, None] ^ near[None]) <= radius)
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want.tolist()))


def test_simhash_groups_leave_no_pair_out(spark, documents, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 40)
    got = [tuple(r) for r in simhash.near_documents(documents).collect()]
    assert len(got) == len(set(got)) and set(got) == near_by_force(rows_of(documents), simhash.RADIUS)


def classes_by_force(rows, radius):
    """Rows of ``simhash.classes`` from all pairs of rows with a fingerprint."""
    found, prints = simhash.fingerprints_of(pa.array([t for _, t in rows], pa.string()))
    print_of = dict(zip(found.tolist(), prints.tolist()))
    own = sorted({(i, print_of.get(k)) for k, (i, _) in enumerate(rows) if i is not None}, key=str)
    up, links = list(range(len(own))), [0] * len(own)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (_, f) in enumerate(own):
        for b, (_, g) in enumerate(own[:a]):
            if f is not None and g is not None and (f ^ g).bit_count() <= radius:
                links[a], links[b] = links[a] + 1, links[b] + 1
                up[root(a)] = root(b)
    team, copy = defaultdict(list), defaultdict(list)
    for k, (i, f) in enumerate(own):
        team[root(k)].append(i)
        copy[f if f is not None else ("none", i)].append(i)
    return sorted((i, min(copy[f if f is not None else ("none", i)]), min(team[root(k)]), links[k]) for k, (i, f) in enumerate(own))


def test_simhash_classes(spark, documents, awkward, empty, monkeypatch):
    """A row for each document, whatever the number of pairs; classes and links of all pairs."""
    rows, some = rows_of(documents), [(i, t) for i, t, *_ in awkward_rows()]
    want = {radius: classes_by_force(rows, radius) for radius in (3, simhash.RADIUS, 22)}
    for radius, blocks in ((3, 6), (simhash.RADIUS, simhash.BLOCKS), (22, 8)):
        assert sorted(map(tuple, simhash.document_classes(documents, radius, blocks).collect())) == want[radius]
    assert len(want[22]) == len(rows) < sum(x[3] for x in want[22]) / 2  # more pairs than documents
    assert sorted(map(tuple, simhash.document_classes(awkward).collect())) == classes_by_force(some, simhash.RADIUS)
    assert simhash.document_classes(empty, weighted=True).count() == 0
    monkeypatch.setattr(simhash, "GROUP", 40)
    monkeypatch.setattr(simhash, "_LINKS", 50)
    assert sorted(map(tuple, simhash.document_classes(documents, 22, 8).collect())) == want[22]


def test_simhash_query_has_a_row_for_each_document(spark, sf_dir, documents):
    from nearfold.llm.queries import op4_simhash

    found = op4_simhash(spark, sf_dir)
    assert found.columns == ["doc_id", "copy_of", "class_id", "links"] and found.count() == documents.count()


def test_simhash_recalls_planted_near_copies(spark):
    """Copies with some words replaced, 3-gram similarity 0.5 to 0.97, and unrelated texts."""
    r = np.random.default_rng(5)
    pool = np.array([f"{z}{a}{b}{c}" for z in ("", "ga", "pol", "ri", "mes", "tu", "ano", "ke") for a in "bdfgklmnprst" for b in ("a", "e", "io", "u", "ei") for c in ("n", "rt", "ss", "", "ling", "mo")])
    rows, planted = [], []
    for k in range(300):
        base = r.choice(pool, int(r.integers(100, 400))).tolist()
        copy = list(base)
        for at in r.choice(len(base), max(1, int(len(base) * r.uniform(0.01, 0.1))), replace=False):
            copy[at] = str(r.choice(pool)) + "x"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        x, y = ({tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (base, copy))
        if len(x & y) >= 0.5 * len(x | y):
            planted.append((2 * k, 2 * k + 1))
    got = {(r.doc_a, r.doc_b) for r in simhash.near_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(planted) > 200 and len(got & set(planted)) >= 0.9 * len(planted)
    assert len(got - {(2 * k, 2 * k + 1) for k in range(300)}) < 0.0001 * len(rows) ** 2 / 2


def passages_by_force(rows):
    """Spans of words whose runs of ``WINDOW`` also stand in another row; places by plain string code."""
    w, owner, shared, parsed = substring.WINDOW, {}, set(), []
    for k, (i, t) in enumerate(rows):
        cut = word_spans(t)
        words, places = tuple(x for x, *_ in cut), [(a, b) for _, a, b in cut]
        parsed.append((i, words, places))
        for n in range(len(words) - w + 1):
            if owner.setdefault(words[n : n + w], k) != k:
                shared.add(words[n : n + w])
    out = set()
    for i, words, places in parsed:
        spans = []
        for k in range(len(words) - w + 1):
            if words[k : k + w] in shared:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + w
                else:
                    spans.append([k, k + w])
        out |= {(i, places[x][0], places[y - 1][1], y - x) for x, y in spans}
    return out


def test_passages(spark, documents):
    got = [tuple(r) for r in substring.repeated_passages(documents, shard_phrases=50).collect()]
    assert len(got) == len(set(got)) and set(got) == passages_by_force(rows_of(documents))


def test_passages_awkward(spark, awkward, empty):
    rows = {(i, t) for i, t, *_ in awkward_rows() if i is not None and t is not None and i not in (11, 14)}
    small = awkward.filter("doc_id IS NULL OR doc_id NOT IN (11, 14)")
    got = {tuple(r) for r in substring.repeated_passages(small).collect()}
    assert got == passages_by_force(sorted(rows)) and {1, 2, 15} <= {g[0] for g in got}
    assert 11 in {r.doc_id for r in substring.repeated_passages(awkward).collect()}
    assert substring.repeated_passages(empty).count() == 0


def test_every_window_holds_a_phrase():
    b = TextBatch(pa.array([prose(3000, 8), "the " * 400]))
    words, first = b.word_hashes(), b.words[2]
    chosen, _ = substring.phrases(words, first)
    for lo, hi in zip(first, first[1:]):
        for at in range(lo, hi - substring.WINDOW + 1):
            assert ((chosen >= at) & (chosen + substring.PHRASE <= at + substring.WINDOW)).any()
