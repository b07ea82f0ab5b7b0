"""The pipeline against brute force, stage by stage on its own input."""

import pandas as pd
import pytest

import corpus_pipeline
from loxis.llm.common import staged

from .test_operators import SHA, alnum, fingerprint, kept_lines, linked

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_columns(kept):
    assert all(d.columns == kept[0].columns for d in kept[:-1])


def test_quality_keeps_what_is_labelled_good(kept):
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").quality
    left = {r.doc_id for r in kept[1].collect()}
    every = {r.doc_id for r in kept[0].collect()}
    wrong = [i for i in every if i in labels.index and (i in left) != bool(labels[i])]
    assert len(wrong) <= 0.05 * len(labels) and len(left) < len(every)


def test_lines(kept):
    rows = [(r.doc_id, r.text) for r in kept[1].collect()]
    assert sorted((r.doc_id, r.text) for r in kept[2].collect()) == sorted((i, t) for i, _, _, t in kept_lines(rows))


def test_near_duplicates(kept):
    rows = [(r.doc_id, fingerprint(r.text)) for r in kept[2].collect()]
    root = linked([f for _, f in rows])
    least = {}
    for i, f in rows:
        least[root[f]] = min(i, least.get(root[f], i))
    assert {r.doc_id for r in kept[3].collect()} == set(least.values())


def test_decontamination(kept):
    windows = set()
    for text in pd.read_parquet(f"{SF}/benchmark.parquet").text:
        w = alnum(text)
        m = min(13, len(w))
        windows |= {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if m else set()
    want = set()
    for r in kept[3].collect():
        w = alnum(r.text)
        if not any(tuple(w[k : k + m]) in windows for m in {len(x) for x in windows} for k in range(len(w) - m + 1)):
            want.add(r.doc_id)
    assert {r.doc_id for r in kept[4].collect()} == want


def test_tokens_decode_to_the_text(kept):
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    out = kept[5].collect()
    assert {r.doc_id: r.decoded_sha256 for r in out} == {i: SHA(t) for i, t in texts.items()}
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == SHA(",".join(map(str, r.ids))) for r in out)


def test_run_is_the_stages_in_order(spark, kept):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, kept[5].collect()))
