import random
import re
from urllib.parse import urldefrag, urljoin, urlsplit

import duckdb
from conftest import SF
from pyspark.sql import functions as F

from tidewell.llm import urls
from tidewell.llm.common import table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_pages_and_odd_urls(spark):
    odd = [None, "", "no scheme", "http://", "HTTP://A.NET/x", "http://net/", "http://xnet/", "http://a.net", "http://a.example.net/en/1", "http://example.net/en", "x://y://z.net/", "http://ÉA.org/fr/?q#f", "http://a.example.com/de/x\ny?p", "https://u@b.net:80/p"]
    rows = [(r.page_id, r.url, r.html) for r in table(spark, SF, "pages").collect()] + [(9000 + i, u, None) for i, u in enumerate(odd)] + [(9000, None, "")]
    frame = spark.createDataFrame([(*r, 7, "x", True) for r in rows], "page_id long, url string, html string, node int, own string, alias boolean")
    got = urls.verdicts(frame).collect()
    want = sorted((i, *brute(u)[:3], brute(u)[3] or "allow") for i, u, _ in rows)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted(want, key=str)


def test_decisions_travel_over_aliases(spark):
    link = '<head><link href="{}" rel="canonical"></head>'
    rows = [
        (1, "http://a.example.com/x", link.format("http://b.example.com/y")),
        (2, "http://b.example.com/y", '<META http-equiv="refresh" content="0; url=http://bad.net/z">'),
        (3, "http://c.example.com/x", '<link rel=canonical href="/de/1">'),
        (4, "http://d.example.com/x", link.format("http://e.org/fr/1")),
        (5, "http://d.example.com/y", '<link rel="canonical" href="x">' + link.format("http://bad.net/q")),
        (6, "http://f.example.com/x", "<p>canonical</p>"),
        (7, "http://g.example.com/", None),
        (8, "http://h.org/fr/2", link.format("http://bad.net/z")),
        (1, "http://a.example.com/x", link.format("http://b.example.com/y")),
    ]
    got = sorted((r.page_id, r.verdict, r.alias_of_block) for r in urls.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert twin(rows) == got
    # 8 is allowed by its own rule and so frees the group of bad.net/z: 1 and 2
    assert got == [(1, "allow", False), (1, "allow", False), (2, "allow", False), (3, "block", True), (4, "allow", False), (5, "allow", False), (6, "allow", False), (7, "allow", False), (8, "allow", False)]
    got = sorted((r.page_id, r.verdict) for r in urls.verdicts(spark.createDataFrame(rows[:7], "page_id long, url string, html string")).collect())
    assert got == [(1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow"), (6, "allow"), (7, "allow")]


def twin(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    found = con.execute(urls.SQL)
    names = [d[0] for d in found.description]
    return sorted((r[names.index("page_id")], r[names.index("verdict")], r[names.index("alias_of_block")]) for r in found.fetchall())


LINKS = ["/go?u=http://bad.net/", "../x", "../../../y", "./a/../b/.", "z#part", "#top", "?q=http://bad.net/", "HTTP://BAD.NET/up", "//bad.net/", "mailto:a@bad.net", "javascript:go()", "a/b?c=../d", "http://h.com", "http://h.com/", "..", "/./../k", "x://y", "a:b", "&amp;x"]


def test_links_resolve_as_the_standard_says(spark):
    bases = ["http://a.example.com/x/y/z?p=1#f", "http://a.example.com", "HTTPS://A.example.com/q"]
    rows = [(b, link) for b in bases for link in LINKS]
    got = spark.createDataFrame(rows, "base string, link string").select("base", "link", urls.absolute(F.col("base"), F.col("link")).alias("to")).collect()

    def known(url):
        u = urlsplit(urldefrag(url)[0])
        return f"{u.scheme}://{u.netloc.lower()}{u.path or '/'}" + (f"?{u.query}" if u.query else "")

    for r in got:
        if r.link in ("mailto:a@bad.net", "javascript:go()", "a:b"):
            assert r.to is None
        else:
            assert r.to == known(urljoin(r.base, r.link.replace("&amp;", "&"))), r


def brute_verdicts(rows):
    """Aliases by a search over the graph of ``link`` attributes, one a page."""
    near = {}

    def known(url):
        u = urlsplit(urldefrag(url)[0])
        path = urlsplit(urljoin(f"http://x{u.path or '/'}", u.path or "/")).path
        return f"{u.scheme}://{u.netloc.lower()}{path}" + (f"?{u.query}" if u.query else "")

    for _, url, html in rows:
        for link in re.findall(r'href="([^"]*)"', html or ""):
            if not re.match(r"[a-z]+:(?!//)", link):
                a, b = known(url), known(urljoin(url, link))
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
    out = []
    for i, url, _ in rows:
        own = brute(url)[3]
        seen, todo = set(), [known(url)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near.get(x, ())
        said = {brute(x)[3] for x in seen}
        by_alias = own is None and "block" in said and "allow" not in said
        out.append((i, own or ("block" if by_alias else "allow"), by_alias))
    return sorted(out)


def test_a_table_of_aliases_equals_brute_force_and_sql(spark):
    rng = random.Random(4)
    hosts = ["a.example.com", "b.example.com", "C.example.com", "bad.net", "ok.org", "d.io", "e.io", "f.io"]
    rows = []
    for i in range(400):
        url = f"http://{rng.choice(hosts)}/{rng.choice(['', 'fr/', 'de/', 'n/'])}{i % 150}{rng.choice(['', '', '#f', '?u=http://bad.net/'])}"
        link = rng.choice([*LINKS, *(f"http://{rng.choice(hosts)}/n/{rng.randrange(150)}" for _ in range(20))])
        rows.append((i, url, f'<link rel="canonical" href="{link}">' if rng.random() < 0.4 else None))
    got = sorted((r.page_id, r.verdict, r.alias_of_block) for r in urls.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == brute_verdicts(rows) == twin(rows)
    assert 5 < sum(x for *_, x in got) < 200


def test_empty(spark):
    assert urls.verdicts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
