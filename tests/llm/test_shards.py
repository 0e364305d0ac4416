import zlib
from collections import Counter

import numpy as np
import pytest

from conftest import SF
from tidewell.llm import shards
from tidewell.llm.common import table


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 100, 1000, 4097])
def test_permutation_and_inverse(n):
    f = shards.Feistel(n)
    out = f(np.arange(n))
    assert sorted(out.tolist()) == list(range(n))
    assert f.inverse(out).tolist() == list(range(n))
    assert n < 100 or out.tolist() != list(range(n))
    assert (shards.Feistel(n, 1)(np.arange(n)) != out).any() or n < 8


def test_law_and_values(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(None, None), (3, ""), (3, ""), (3, None), (10**12, "é")], "doc_id long, text string")
    docs = docs.union(extra).withColumn("shard", docs.doc_id * 0)
    rows = shards.report(docs).collect()
    assert len(rows) == docs.count()
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    texts = Counter((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == texts
    by_number = sorted(rows, key=lambda r: r.row_number)
    assert [r.row_number for r in by_number] == list(range(len(rows)))
    ids = [-1 if r.doc_id is None else r.doc_id for r in by_number]
    assert ids == sorted(ids)
    place = shards.Feistel(len(rows))(np.arange(len(rows)))
    assert [(r.shard, r.slot) for r in by_number] == [(p % 8, p // 8) for p in place.tolist()]
    assert sorted(map(str, shards.report(docs.repartition(7)).collect())) == sorted(map(str, rows))


def test_empty(spark):
    assert shards.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
