import random
import re

from tidewell.llm import secrets
from tidewell.llm.automaton import Rule, compile_rules, scan

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_random_texts_match_brute_force():
    rng = random.Random(7)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "AKIA", "=", ":", " ", '"', "'", "\n", ".", "é", "日", "abcdef0123456789", "ABCDEFGH12345678", "x", "-", "tok", "eyJ", "AK", "deadbeefdeadbeef"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for text, spans in zip(texts, secrets.spans_of(texts), strict=True):
        assert [x for x in spans if x[0] in secrets.BASE_KINDS] == brute(text), text


#: The added kinds as plain patterns, and the least length of their last group.
ADDED = {"forge": (r"gh[opusr]_([A-Za-z0-9]+)", 36), "chat": (r"xox[abprs]-([A-Za-z0-9-]+)", 10), "jwt": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)", 8), "pem": (r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY(-----)", 0)}


def test_added_kinds_match_brute_force():
    rng = random.Random(8)
    parts = ["gh", "ghp_", "gho_", "_", "xox", "xoxb-", "xoxz-", "-", "eyJ", "eyJhbGci", "eyJhbGci.eyJz.", ".", "abc", "A1b2C3d4E5F6", "0123456789abcdef" * 2, " ", "-----", "BEGIN ", "RSA ", "PRIVATE KEY", "-----BEGIN ", "PRIVATE KEY-----", "é", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    seen = dict.fromkeys(ADDED, 0)
    for text, spans in zip(texts, secrets.spans_of(texts), strict=True):
        for kind, (pattern, least) in ADDED.items():
            want = [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if len(m[1]) >= least]
            assert [x for x in spans if x[0] == kind] == want, text
            seen[kind] += len(want)
    assert min(seen.values()) > 20, seen


def test_edges():
    assert secrets.spans_of([None, "", "token=password:abcdefghijklmnop", "tokentoken = abcdefghijkl"]) == [[], [], [], [("assign", 5, 25)]]
    long = "a1" * 300_000
    assert secrets.spans_of([long + "g"]) == [[("hex", 0, 600_000)]]
    assert secrets.spans_of(["ghp_" + "a" * 36]) == [[("forge", 0, 40), ("hex", 4, 40)]]
    assert secrets.spans_of(["x -----BEGIN RSA PRIVATE KEY----- y"]) == [[("pem", 2, 33)]]


def test_automaton_is_minimal_and_small():
    s = compile_rules([Rule("a", "ab+"), Rule("b", "ab+")])
    assert s.states == 3
    assert scan(s, [b"xabbab"]) == [[(0, 1, 4), (0, 4, 6), (1, 1, 4), (1, 4, 6)]]
    assert secrets.scanner_for().states < 20_000


def test_report_and_redaction(spark):
    rows = [(1, "token = abcdefghijklmnop", 5, "z"), (1, "token = abcdefghijklmnop", 5, "z"), (2, None, None, None), (3, "", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, secret_spans string")
    got = sorted(secrets.report(docs).collect())
    assert [(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.spans) for r in got] == [(1, 1, 0, 0, "assign:0:24")] * 2 + [(2, 0, 0, 0, ""), (3, 0, 0, 0, "")]
    assert got[0].base_sha256 == secrets.digest([("assign", 0, 24)])
    out = sorted(secrets.redact(docs).collect(), key=str)
    assert out[0].text == "[SECRET]" and out[0].n_chars == 8 and out[0].secret_spans == "z"
    assert secrets.report(docs.limit(0)).count() == 0
