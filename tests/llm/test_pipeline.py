"""The stages one after the other, and the whole, against what their operators say."""

import os
import re

import pyarrow as pa
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from nearfold.llm import bpe, langid, pii, queries
from test_dedup import groups_by_force
from test_text_operators import passages_by_force as windows_by_force
from test_tokens import PATTERN


def test_stage_order_and_registration():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["identify_language", "drop_near_duplicates", "decontaminate", "redact_pii", "encode"]
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 11))


def test_run(spark, documents, texts, sf_dir):
    docs, seen = documents, [set(texts)]
    for name, stage in corpus_pipeline.STAGES:
        last = name == corpus_pipeline.STAGES[-1][0]
        docs = stage(spark, docs, sf_dir)
        assert last or docs.columns == documents.columns
        docs = docs.cache()
        seen.append({r.doc_id for r in docs.collect()})
        assert seen[-1] <= seen[-2]
    assert seen[-1] == seen[-2] and 0.7 * len(texts) < len(seen[-1]) < len(texts)
    got = corpus_pipeline.run(spark, sf_dir)
    key = lambda rows: sorted((r.doc_id, r.token_ids) for r in rows)
    assert key(got.collect()) == key(docs.collect())
    back = {r.doc_id: r.text for r in bpe.decode(docs).collect()}
    assert not any("@" in t for t in back.values())
    assert sum(back[i] == texts[i] for i in back) > 0.8 * len(back)


def test_run_by_force(spark, documents, sf_dir):
    """The rows of ``run`` by plain code: labels, all pairs, all windows, redactions and a public tokenizer, text by text."""
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    model = langid.fit(documents)
    rows = [x for x, said in zip(rows, langid.label(pa.array([t for _, t in rows]), model)) if said["lang"] != "und"]
    copies = {i: min(g) for g in groups_by_force(rows) for i in g}
    rows = [(i, t) for i, t in rows if copies.get(i, i) == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {i for i, _ in windows_by_force(rows, items)}
    trained, public = pii.train(), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.Vocabulary.read(bpe.VOCABULARY).ranks, special_tokens={})
    want = {i: public.encode_ordinary(pii.redact(t, pii.detect(t, trained))) for i, t in rows if i not in leaks}
    assert {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, sf_dir).collect()} == want


def test_stages_awkward(spark, awkward, empty, sf_dir):
    for rows in (awkward, empty):
        docs = rows
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, sf_dir)
            assert k == 4 or docs.columns == rows.columns
        left = [r.doc_id for r in docs.collect()]
        assert len(left) == len(set(left)) and (not left or {1, 11, 12, 16} <= set(left))


@pytest.mark.parametrize("word", ["Checkpoint("])
def test_no_copy_that_only_one_executor_holds(word):
    top = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for folder, _, files in os.walk(os.path.join(top, "nearfold")):
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as source:
                    assert "local" + word not in source.read()
