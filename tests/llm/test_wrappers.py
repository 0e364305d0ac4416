import html
import random
import re
import time

from conftest import SF

from tidewell.llm import wrappers
from tidewell.llm.common import table


def brute(page):
    """For pages of the test tables: one article of h1 and p."""
    body = re.search(r"(?s)<article>(.*?)(</article>|\Z)", page)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(x for x in parts if x)


def test_pages_of_the_tables(spark):
    for path in (SF, "/root/testdata/sf0.01"):
        pages = table(spark, path, "pages")
        rows = pages.collect()
        got = {r.page_id: r for r in wrappers.extract(pages).collect()}
        assert len(got) == len(rows)
        for r in rows:
            assert got[r.page_id].text == brute(r.html) and got[r.page_id].n_chars == len(brute(r.html))


def inferred(*pages):
    trees = sorted((wrappers.tree_of(x)[0] for x in pages), key=wrappers.skeleton)
    tree = trees[0]
    for x in trees[1:]:
        tree = wrappers.aligned(tree, x)
    return wrappers.Wrapper(tree)


def one(page, *others):
    return wrappers.text_of(page, inferred(page, *others))


def test_expressions_have_groups_and_options():
    a = wrappers.tree_of("<body><ul><li>x<li>y</ul><h1>t</h1><p>a</p><p>b</p></body>")[0]
    b = wrappers.tree_of("<body><h1>u</h1><p>c</p><div>z</div></body>")[0]
    assert "(<ul>" in wrappers.expression(wrappers.aligned(a, b)) and ")?" in wrappers.expression(wrappers.aligned(a, b))
    assert "(<p>" in wrappers.expression(a) and ")+" in wrappers.expression(a)


def test_furniture_goes():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="home"><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>
    <div class="cookie-notice">We use cookies</div><main><article class="post"><header><h1>Head&amp;line</h1><p>by X</p></header>
    <p>One <b>two</b>
      three&nbsp;<a href="y>z">four</a>.<p>Next<script>var a="</p>";</script> one<br>more</p><ul><li>i1<li>i2</ul><!-- no <p>x</p> -->
    <form><input><button>Go</button>label</form><div class="ads">Buy</div><aside>Side</aside><div id="comments"><p>Reader says</p></div>
    <table><tr><td>c1<td>c2</table>a &lt; b</article></main><div class='sidebar'>s</div><footer>&copy; X</footer></body>"""
    assert one(page) == "Head&line\nOne two three four.\nNext one more\ni1\ni2\nc1\nc2\na < b"


def test_without_an_article_constant_and_linked_slots_go():
    page = "<body><div><p>Welcome to the site</p></div><table><tr><td>{}</td></tr></table><ul><li><a href=1>{}</a></ul></body>"
    texts = ["The first text of its own.", "The second text, another.", "A third and longer one."]
    pages = [page.format(t, t.split()[1]) for t in texts]
    assert one(*pages) == texts[0]
    assert one("<p>alone</p>") == "alone"
    assert one("<article><p title=\"unclosed>one</p><p>it's two</p></article>") == "one\nit's two"


WORDS = "amber birch cedar dune ember fjord grove heath inlet jetty knoll lagoon marsh north opal pine quarry ridge slope tarn".split()


def generated(rng, host, n):
    """Pages of one template without article, main or telling names: header line, links, body, box, footer, in divs alone. Also the bodies."""
    sentence = lambda k: " ".join(rng.choice(WORDS) for _ in range(k)).capitalize() + "."
    line, foot, box = sentence(6), sentence(9), sentence(5)
    menu = "".join(f"<div><a href=/{i}>{rng.choice(WORDS)}</a></div>" for i in range(5))
    style = rng.randrange(3)
    out = []
    for i in range(n):
        body = [sentence(4)] + [sentence(rng.randint(20, 60)) for _ in range(rng.randint(2, 6))]
        more = "".join(f"<div><a href=/m{j}>{sentence(3)}</a></div>" for j in range(rng.randint(1, 4)))
        if style == 0:
            core = f"<div><h2>{body[0]}</h2>" + "".join(f"<p>{t}</p>" for t in body[1:]) + "</div>"
        elif style == 1:
            core = f"<div><div>{body[0]}</div><div><p>" + "<p>".join(body[1:]) + "</div></div>"
        else:
            core = f"<table><tr><td><h1>{body[0]}</h1><p>" + "</p><p>".join(body[1:]) + "</p></td></tr></table>"
        notice = f"<div><div>{box}</div></div>" if rng.random() < 0.5 else ""
        out.append((host, i, f"<html><body><div>{line}</div><div>{menu}</div>{notice}{core}<div>{more}</div><div>{foot}</div></body></html>", "\n".join(body)))
    return out


def test_templates_without_names_are_told_by_their_slots(spark):
    rng = random.Random(11)
    rows = [(f"http://h{h}.x/{i}", page, body) for h in range(30) for h, i, page, body in generated(rng, h, rng.randint(4, 15))]
    frame = spark.createDataFrame([(n, u, p) for n, (u, p, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(frame).collect()}
    wrong = [(got[n], body) for n, (_, _, body) in enumerate(rows) if got[n] != body]
    assert not wrong, (len(wrong), len(rows), wrong[0])
    by_names = ["\n".join(b.text for b in wrappers.parsed(p)[1]) for _, p, _ in rows]  # no name tells anything here: a filter by names keeps all
    assert not any(text == body for text, (_, _, body) in zip(by_names, rows, strict=True))
    alone = sum(wrappers.text_of(p, wrappers.Wrapper(wrappers.tree_of(p)[0])) == body for _, p, body in rows)
    assert alone < len(rows)  # nor does a page always tell without its host's others


def test_wrappers_are_the_same_at_any_partitioning(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, f"http://h{h % 2}.x/{i}", page) for h in range(6) for _, i, page, _ in generated(rng, h, 12)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for many in (256, 4):
        monkeypatch.setattr(wrappers, "ALIGNED", many)
        found = [sorted(map(tuple, wrappers.wrappers(frame.repartition(n)).collect())) for n in (1, 7)]
        assert found[0] == found[1] and len(found[0]) == 2


def test_names_need_what_else_is_known():
    text = " ".join(WORDS * 20)
    for name in ("content has-sidebar", "comments-open", "social-justice", "header-content", "tabs", "ads"):
        assert one(f"<body><nav>x</nav><div class='{name}'><h1>Title</h1><p>{text}</p></div><div class=sidebar>side</div></body>") == f"Title\n{text}"
        assert one(f"<body><article><div class='{name}'><h1>Title</h1><p>{text}</p></div></article></body>") == f"Title\n{text}"
    assert one(f"<article><div class='article-header'><h1>Title</h1></div><p>{text}</p><div class='social-justice'><p>On justice.</p></div></article>") == f"Title\n{text}\nOn justice."
    assert one(f"<form><div><p>{text}</p></div><input name=q></form>") == text
    assert one(f"<article><p>{text}</p><article class=comment>So true</article></article>") == text
    assert one("<nav><a href=1>only a menu</a></nav>") == ""


def test_template_text_inside_an_article_goes():
    page = "<article><h1>{0}</h1><div><p>{1}</p><p>{2}</p></div><div>Share this with a friend</div></article>"
    pages = [page.format(*rng) for rng in (("T one", "a b c", "d"), ("T two", "e f", "g h"), ("T three", "i", "j k l"))]
    assert one(*pages) == "T one\na b c\nd"
    assert one(pages[0], pages[0], pages[0]) == "T one\na b c\nd\nShare this with a friend"  # copies of one page tell nothing


def test_no_caps():
    deep = "<div>" * 70 + "<nav>MENU</nav><article><p>body</p></article>"
    assert one(deep) == "body"
    assert one("<div><section>" * 2000 + "<nav>MENU</nav><article><p>body</p></article>") == "body"
    assert one("<article>" + "<b>x<div>" * 3000 + "<nav>MENU</nav>").replace("\n", "") == "x" * 3000
    uri = "data:image/svg+xml," + "<path d='m'/>" * 30_000
    assert one(f'<article><p>before</p><img src="{uri}"><p>after</p></article>') == "before\nafter"
    assert one("<article>" + "<h2>h</h2><p>p</p>" * 20_000 + "</article>") == "\n".join("hp" * 20_000)
    assert one("<article>" + "".join(f"<z{i}>t{i}</z{i}>" for i in range(5000)) + "</article>") == "\n".join(f"t{i}" for i in range(5000))
    begin = time.time()
    one("<a '" * 50_000 + "<p>x</p>")
    one("<li><ul>" * 20_000)
    assert time.time() - begin < 20


def test_odd_pages(spark):
    rows = [(1, "http://a.x/1", None, "q"), (2, "http://a.x/2", "", "q"), (3, None, "<p>x", "q"), (4, "http://a.x/4", "no markup & more", "q"), (5, "http://b.x/", "<article>" + "<div>" * 300 + "deep", "q"), (5, "http://b.x/", "<article>" + "<div>" * 300 + "deep", "q"), (6, "http://c.x", "<p>" * 5000 + "a < b <", None)]
    rows = [(*r, 1, "x") for r in rows]
    got = sorted((r.page_id, r.text, r.n_chars) for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int, wrapper string")).collect())
    assert got == [(1, "", 0), (2, "", 0), (3, "x", 1), (4, "no markup & more", 16), (5, "deep", 4), (5, "deep", 4), (6, "a < b <", 7)]
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_pages_take_linear_time():
    """Chains of inline elements, runs of siblings and inline elements left open, a megabyte each: seconds, where a second walk over all that is open would take hours."""
    import time

    pages = ["<b><i>" * 75_000 + "x" + "</i></b>" * 75_000, "<p>a" * 250_000, "<b>" * 100_000 + "<p>a</p>" * 90_000]
    begin = time.process_time()
    trees = [wrappers.tree_of(page) for page in pages]
    assert time.process_time() - begin < 60
    assert [len(blocks) for _, blocks in trees] == [1, 250_000, 90_000]


def test_long_alignments_equal_short_ones(monkeypatch):
    r = random.Random(5)
    for _ in range(400):
        a, b = ([[r.choice("pqrs"), False, False, 1, [["", False, False, 1, r.choice("uvw"), 3, 0, [1]], ["z" * r.randint(1, 2), False, False, 1, []]][: r.randint(0, 2)]] for _ in range(r.randint(0, 25))] for _ in range(2))
        monkeypatch.setattr(wrappers, "CELLS", 1 << 30)
        want = wrappers.pairs(a, b)
        monkeypatch.setattr(wrappers, "CELLS", -1)
        assert wrappers.pairs(a, b) == want


def test_the_number_of_siblings_changes_nothing():
    """Pages of h2 and p pairs that end in one constant paragraph: it is the template's, with six siblings or a thousand."""
    for box in ("div", "article"):
        for n in (6, 30, 33, 41, 300, 500):
            pages = [f"<body><{box}>" + "".join(f"<h2>Title {k} {i}</h2><p>Own text {k} of part {i}.</p>" for i in range(n + k)) + f"<h2>Last {k}</h2><p>Subscribe to our letter</p></{box}></body>" for k in range(6)]
            whole = inferred(*pages)
            for k, page in enumerate(pages):
                assert wrappers.text_of(page, whole).endswith(f"Last {k}")


def test_pages_of_thousands_of_unlike_siblings_take_seconds():
    begin = time.process_time()
    pages = ["<article>" + "".join(f"<h2>T {k} {i}</h2><p>text {k} {i}</p>" for i in range(3000 + k)) + "</article>" for k in range(3)]
    whole = inferred(*pages)
    assert wrappers.text_of(pages[0], whole).count("\n") == 5999
    assert time.process_time() - begin < 30


def test_unclosed_quotes_take_linear_time():
    for unit in ("<a '", "<a \"<a ", "<a x\"='</a <!\">\"", "<a \"'<b>"):
        begin = time.process_time()
        wrappers.tree_of(unit * 50_000)
        assert time.process_time() - begin < 10
    assert one("<article>" + "<i '>a" * 101 + "<p title='x>y'>b</p></article>").endswith("b")


def test_pages_behind_their_wrapper_give_the_same(spark, monkeypatch):
    pages = table(spark, SF, "pages").unionByName(spark.createDataFrame([(90001, None, "<p>alone</p>"), (90002, "http://n.x/", None)], "page_id long, url string, html string"), allowMissingColumns=True)
    want = sorted(map(tuple, wrappers.extract(pages).collect()))
    monkeypatch.setattr(wrappers, "SENT", 0)
    monkeypatch.setattr(wrappers, "PART", 20_000)
    assert sorted(map(tuple, wrappers.extract(pages).collect())) == want
    assert wrappers.extract(pages.limit(0)).count() == 0
