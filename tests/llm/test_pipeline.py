"""The pipeline against a plain version of each stage."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken
from conftest import SF
from test_mixing import poisson, uniform
from test_quality import brute as measures
from test_secrets import ASSIGN
from test_near_copies import brute as brute_groups

import corpus_pipeline
from tidewell.llm import bpe, secrets
from tidewell.llm.common import settle, table


def test_stages(spark):
    docs = table(spark, SF, "documents")
    out, frames = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, out, SF), "test") if name != "tokens" else stage(spark, out, SF)
        frames.append(out)
        assert name == "tokens" or out.columns == docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    good = {i for i, r in rows.items() if not measures(r.text)[5]}
    assert {r.doc_id for r in frames[0].collect()} == good
    group = brute_groups([(i, rows[i].text) for i in sorted(good)])
    kept = {r.doc_id for r in frames[1].collect()}
    assert kept == {i for i, c in group.items() if i == c}
    clean = {r.doc_id: r for r in frames[2].collect()}
    assert clean.keys() == kept
    assert all(not [m for m in ASSIGN.finditer(r.text) if len(m[2]) >= 12] and r.n_chars == len(r.text) for r in clean.values())
    assert all(r.text == rows[i].text for i, r in clean.items() if not secrets.spans_of([rows[i].text])[0])
    size = Counter()
    for r in clean.values():
        size[r.source] += len(r.text.encode()) + 1
    wish = {s: b**0.7 for s, b in size.items()}
    rate = {s: wish[s] / sum(wish.values()) * sum(size.values()) / b for s, b in size.items()}
    want = Counter({i: poisson(rate[r.source], uniform(i)) for i, r in clean.items()})
    mixed = [r.doc_id for r in frames[3].collect()]
    assert Counter(mixed) == +want
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load(P.path("byte_bpe_50k.tiktoken")).ranks, special_tokens={})
    tokens = frames[4].collect()
    assert Counter(r.doc_id for r in tokens) == +want
    for r in tokens:
        ids = encoding.encode_ordinary(clean[r.doc_id].text)
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(clean[r.doc_id].text.encode()).hexdigest()


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, host int, steps int, _n double"
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", None, 1), (3, long, "en", None, 1), (None, long + " x", "en", "a", 1), (4, long.replace("w", "v"), None, "a", None)]
    rows = [(*r, "n", 1, 2, 0.5) for r in rows]
    out = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, out, SF), "test")
        if name == "near duplicates":
            assert sorted(str(r.doc_id) for r in out.collect()) == ["3", "4", "None"]
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = settle(stage(spark, empty, SF), "test")
    assert empty.count() == 0
