import re
from collections import Counter

import duckdb
from conftest import SF

from tidewell.llm import quality
from tidewell.llm.common import table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {k for i, w in enumerate(windows) if count[w] > 1 for k in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string, host string")


ODD = [None, "", " \n\t", "a " * 100, "x\x0by\x0cz\rw", "é# $\n é# $\né# $", "a b c d e f g h " * 3, " ".join(map(str, range(50))), ("line of words\n" * 4) + " ".join(map(str, range(60))), "a b c   d"]


def test_against_brute_force(spark):
    rows = [(r.doc_id, r.text, r.source, "x", "y") for r in table(spark, SF, "documents").collect()] + [(5000 + i, t, None, None, None) for i, t in enumerate(ODD)] * 2
    got = quality.report(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted((r[0], *brute(r[1])) for r in rows)
    kept = sorted(r.doc_id for r in got if r.kept)
    out = quality.keep(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "n_words", "host"]
    assert sorted(r.doc_id for r in out.collect()) == kept and kept


def test_hosts_with_almost_only_failures_go(spark):
    good = " ".join(map(str, range(40)))
    rows = [(i, good if i % 10 else "", f"s{i % 7}", "", "") for i in range(700)] + [(1000 + i, "bad" if i else good, "junk", "", "") for i in range(300)] + [(2000, "one", "tiny", "", "")]
    got = {r.doc_id: r for r in quality.report(frame(spark, rows)).collect()}
    assert got[1000].host_rejected and not got[1000].base_failed and not got[1000].kept
    assert not got[2000].host_rejected  # one document says little
    assert sum(r.kept for r in got.values()) == 630
    assert quality.keep(frame(spark, rows)).count() == 630


def test_sql_and_empty(spark):
    got = sorted(tuple(r) for r in quality.report(table(spark, SF, "documents")).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(con.sql(quality.SQL).fetchall())
    assert quality.report(frame(spark, [])).count() == 0
    assert quality.keep(frame(spark, [])).count() == 0
