"""Hand-built cases with values that follow from the definitions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.functions import common
from tidewell.operators import content, coverage, editorial, events, growth, laws, learning, preparation, sources, text
from tidewell.plans.components import components
from tidewell.sinks import writers
from tidewell.sources import readers


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_rounding_and_medians(spark):
    assert values(spark, [(2.5,), (-2.5,), (1.4,)], "x double", common.half_up(F.col("x")), F.bround("x"), F.round("x")) == [(3, 2.0, 3.0), (-2, -2.0, -3.0), (1, 1.0, 1.0)]
    assert values(spark, [([1, 9, 3, 4],), ([5],)], "x array<int>", common.upper_median(F.col("x"))) == [(4,), (5,)]
    assert values(spark, [("Ñandú ÉLÈVE",)], "x string", common.fold(F.col("x"))) == [("nandu eleve",)]


def test_article_numbers(spark):
    # fixed titles and numbers
    titles = {"Artículo 31 bis": "31bis", "Artículo\xa0588 bis a)": "588bisa", "Artículo 172 quater": "172quater", "Artículo 216 bis 2": "216bis2", "Artículo 1. Objeto": "1", "Disposición adicional primera": None,
              "Art 239 bis": "239bis", "Art. 1863 bis": "1863bis", "Artículo 570 quáter": "570quater", "Arts. 1863 bis a 1873 bis.": None, "Art. 1231 A 1253": None}
    got = [x for (x,) in values(spark, [(t,) for t in titles], "t string", laws.article_number(F.col("t")))]
    assert got == list(titles.values())


def test_numbers_of_posts(spark):
    rows = [("2.2.1 Plaza de prueba",), ("Se convocan 2.704 plazas",), ("una plaza libre",), ("ninguna",), ("12 plazas",)]
    assert [x for (x,) in values(spark, rows, "t string", text.posts_of(F.col("t")))] == [None, 2704, 1, None, 12]


def test_scale_and_footrule(spark):
    rows = [(95.0,), (90.0,), (9.0,), (5.0,), (4.9,)]
    assert [x for (x,) in values(spark, rows, "v double", learning.scale_points(F.col("v")))] == [0, 1, 9, 9, 10]
    order = F.array(*[F.lit(i).cast("long") for i in range(4)])
    assert [x for (x,) in values(spark, [([0, 1, 2, 3],), ([3, 2, 1, 0],)], "o array<long>", learning.footrule(F.col("o"), order))] == [10.0, 0.0]


def test_repetition(spark):
    t = datetime(2024, 1, 1)
    rows = [(i, 1, t + timedelta(minutes=i), 7, ok) for i, ok in enumerate([True, False, True, True])] + [(9, 1, t, 8, False)]
    a = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, item long, correct boolean")
    s = {r["item"]: r for r in learning.item_states(a).withColumn("due", learning.next_review(F.col("last_ts"), F.col("streak"))).withColumn("state", learning.state_of(F.col("ok"), F.col("ko"), F.col("streak"))).collect()}
    assert (s[7].ok, s[7].ko, s[7].streak, s[7].state) == (3, 1, 2, "learned")
    assert s[7].due == t + timedelta(days=3, minutes=3) and s[7].last_fail_ts == t + timedelta(minutes=1)
    assert (s[8].streak, s[8].state, s[8].due) == (0, "failed", t)


def test_marks(spark):
    rows = [(6, 3, 10), (8, 1, 10), (0, 9, 10)]
    assert [x for (x,) in values(spark, rows, "ok int, ko int, n int", learning.penalised(F.col("ok"), F.col("ko"), F.col("n")))] == [5.0, 7.7, 0.0]


def test_variants_are_spread(spark):
    n = spark.range(6000).select(growth.variant("e", F.concat(F.lit("u"), "id"), (1, 1, 1)).alias("v")).groupBy("v").count().collect()
    assert len(n) == 3 and min(r["count"] for r in n) > 1700


def test_importance(spark):
    rows = [("purchase", 90), ("purchase", 40), ("signup", 30), ("error", 1), ("view", 70), ("view", 1), ("signup", 1)]
    assert [x for (x,) in values(spark, rows, "k string, n int", events.importance(F.col("k"), F.col("n")))] == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW"]


def test_similarity(spark):
    rows = [(["a", "b", "c"], ["b", "c", "d"]), ([], []), (["a"], ["a", "b"])]
    assert values(spark, rows, "x array<string>, y array<string>", common.jaccard(F.col("x"), F.col("y")), common.containment(F.col("x"), F.col("y"))) == [(0.5, 2 / 3), (0.0, 0.0), (0.5, 1.0)]
    sets = spark.createDataFrame([(1, 0, ["a", "b", "c", "d", "e"]), (2, 0, ["a", "b", "c", "d", "e", "f"]), (3, 1, ["a", "b", "c", "d", "e"]), (4, 0, ["x", "y"]), (5, 0, [])], "id long, block int, words array<string>")
    assert [(r.a, r.b, round(r.similarity, 3)) for r in content.prefix_pairs(sets, "block", 0.6).collect()] == [(1, 2, 0.833)]


def test_apportionment_adds_up(spark):
    rows = [("g", k, w) for k, w in (("a", 60), ("b", 30), ("c", 10))] + [("h", k, 1) for k in "abcdefg"]
    got = coverage.largest_remainder(spark.createDataFrame(rows, "g string, k string, w long"), "g", "k", "w", F.lit(20)).collect()
    assert {r.k: r.seats for r in got if r.g == "g"} == {"a": 12, "b": 6, "c": 2}
    assert sorted(r.seats for r in got if r.g == "h") == [2, 3, 3, 3, 3, 3, 3]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "b", 2), (2, "c", 1), (2, "d", 2)], "k int, v string, t int")
    assert sorted(map(tuple, writers.append_new(old, new, "k", ["t"]).collect())) == [(2, "c", 1)]
    assert sorted(map(tuple, writers.upsert(old, new, ["k"], F.col("t")).collect())) == [(1, "b", 2), (2, "d", 2)]
    assert sorted(map(tuple, writers.keep_last(new, ["k"], [F.desc("t")], 1).collect())) == [(1, "b", 2), (2, "d", 2)]
    at = str(tmp_path / "t")
    assert writers.write_if_changed(new, None, at) and not writers.write_if_changed(new.withColumn("t", F.lit(9)), new, at, ("t",))
    writers.append_by_month(spark.sql("SELECT timestamp'2024-02-03' AS ts, 1 AS x"), "ts", str(tmp_path / "m"))
    assert (tmp_path / "m" / "ym=2024-02").is_dir()
    writers.assert_no_secret(new, ["v"], ["zzz"])
    with pytest.raises(ValueError):
        writers.assert_no_secret(new, ["v"], ["c"])


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿x;y\n1;2,5\n", encoding="utf-8")
    assert [tuple(r) for r in readers.sniffed_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", "2,5")]
    (tmp_path / "b.csv").write_text("x,y\n1,q\nz,q\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        readers.sniffed_csv(spark, str(tmp_path / "b.csv"), "x int, y string").collect()
    for name in ("q-one", "q-two"):
        (tmp_path / f"{name}.json").write_text('[{"n": 1}, {"n": 2}]')
    got = readers.with_slug(spark, str(tmp_path / "q-*.json"), "n int", r"q-([^/]+)\.json$")
    assert sorted(map(tuple, got.collect())) == [(1, "one"), (1, "two"), (2, "one"), (2, "two")]
    assert readers.json_or_empty(spark, str(tmp_path / "none.json"), "n int").collect() == []
    (tmp_path / "l.jsonl").write_text('{"n": 1}\n\n{"n": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "l.jsonl"), "n int").count() == 2
    (tmp_path / "x.xml").write_text("<r><b id='1'><v>old</v><v>new</v></b><b id='2'><v>only</v></b></r>")
    rows = readers.xml_rows(spark, str(tmp_path / "x.xml"), "b", "_id int, v array<string>")
    assert sorted(map(tuple, rows.select("_id", readers.last_version(F.col("v"))).collect())) == [(1, "new"), (2, "only")]
    kinds = values(spark, [("text/html; x", "a.pdf"), (None, "http://x/a.PDF?q"), ("", "b"), ("application/xml", None)], "c string, u string", readers.content_kind(F.col("c"), F.col("u")))
    assert [k for (k,) in kinds] == ["html", "pdf", "html", "xml"]
    lists = values(spark, [('{"n": 1}',), ('[{"n": 1}, {"n": 2}]',), (None,)], "t string", F.size(readers.as_list(F.col("t"), "struct<n:int>")))
    assert [n for (n,) in lists] == [1, 2, 0]


def test_component_demand(spark):
    rows = [(1, 101, 2), (1, 102, 3), (2, 102, 1), (5, 110, 4), (5, 110, 6), (9, 120, 1)]
    got = sorted(tuple(r) for r in coverage.component_demand(spark.createDataFrame(rows, "a long, b long, n long")).collect())
    assert got == [(1, 2, 2, 6, 3), (5, 1, 1, 10, 6), (9, 1, 1, 1, 1)]


def test_containment_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    sets = {i: sorted({f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randint(1, 12))}) for i in range(120)}
    got = {(r.earlier, r.id) for r in content.containment_pairs(spark.createDataFrame(list(sets.items()), "id long, words array<string>"), 0.7).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= 0.7 * min(len(sets[a]), len(sets[b])) - 1e-9}
    assert got == want and want


def test_number_words(spark):
    rows = [("treinta y cinco",), ("vigésimo tercero",), ("décimo",), ("ciento uno",), ("sin número",), ("",)]
    assert [x for (x,) in values(spark, rows, "t string", laws.number_of(F.col("t")))] == [35, 23, 10, 101, None, None]


def test_message_codes(spark):
    import hashlib
    import hmac

    rows = [("",), ("payload ñ",), ("x" * 500,)]
    got = [x for (x,) in values(spark, rows, "m string", editorial.hmac_sha256(b"secret key", F.col("m")))]
    assert got == [hmac.new(b"secret key", m.encode(), hashlib.sha256).hexdigest() for (m,) in rows]


def test_titles_are_cut_between_words(spark):
    rows = [("Ley de la cosa",), ("Una ley que regula el uso de la palabra y de los signos",), ("Sin   espacios  dobles",)]
    assert [x for (x,) in values(spark, rows, "t string", editorial.cut_at_word(F.col("t"), 30))] == ["Ley de la cosa", "Una ley que regula el uso", "Sin espacios dobles"]


def test_levels_go_up_after_two_hits_and_down_on_a_miss(spark):
    rows = [([True] * 6,), ([True, True, False, True, True],), ([False, False],), ([],)]
    got = [tuple(x) for (x,) in values(spark, rows, "h array<boolean>", preparation.adaptive_level(F.col("h")))]
    assert got == [(6, 6, 3, 2), (5, 4, 2, 0), (2, 0, 1, 0), (0, 0, 1, 0)]


def test_laws_drop_quoted_articles(spark):
    law = "## TÍTULO I\n##### Artículo 5. Uno.\na\n##### Artículo 6 bis\nb\n##### Artículo 3. Citado\nc\n#### Sección\nd\n## Disposición final\ne\n##### Artículo séptimo.\nf"
    got = [(r.n, r.title, r.block, r.body) for r in laws.law_articles(spark.createDataFrame([(1, law)], "id int, text string")).orderBy("n").collect()]
    assert got == [("5", "Uno", "TÍTULO I", "a"), ("6bis", "", "TÍTULO I", "b"), ("7", "", "TÍTULO I", "f")]


def test_descent_finds_records_at_any_depth(spark):
    deep = '{"id": "1", "t": "a", "x": [{"y": {"id": "2", "t": "b"}}, 7, {"id": "3"}], "z": {"id": "4", "t": "d", "w": [[{"id": "5", "t": "e"}]]}}'
    rows = [(1, deep), (2, "no json"), (3, None)]
    got = sorted(tuple(r) for r in sources.descend(spark.createDataFrame(rows, "k int, j string"), "j", ("id", "t")).collect())
    assert got == [(1, "1", "a"), (1, "2", "b"), (1, "4", "d"), (1, "5", "e")]


def test_signs_count_as_their_patterns(spark):
    import re

    texts = ["", "fa fa fa ", "fa  fa fa", "error errors terror", "l'any l'any", " l'any.l'any", "col.labor col-labor collabor col\nlabor", "error\u0001error", "\u0001\u0001fa \u0001fa ", "primer primero primer ", "ñerror·error9error", "any l'\u0001any"]
    signs = ["fa ", "error", "error", "l'any", "col.labor", "primer ", "primer", "primero"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("m", content._marked(F.col("t")))
    want = [sum(len(re.findall(f"(?:^|[^a-z]){w}", t)) for w in signs) for t in texts]
    assert [r.n for r in df.select(content._count("t", "m", signs).alias("n")).collect()] == want


def test_answers_are_scored_in_few_steps(spark):
    """The plan of the scores holds each text form once; it used to repeat them for every sign."""
    a = spark.createDataFrame([(1, "Vaig decidir parlar amb l'equip", True, "Un problema", ["cooperacio"])], "id long, answer string, behaviour boolean, scenario string, asked array<string>")
    plan = content.answer_scores(a, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 2


def test_passes_are_walked_on_counts(spark):
    """Events are counted by kind once; a chain that arrives twice counts as one."""
    follows = {"a": ("b", "c"), "b": ("d",), "c": ("d",)}
    events_ = spark.createDataFrame([("a", "a:1"), ("a", "a:2"), ("b", "b:1"), ("z", "z:1")], "kind string, key string")
    got = {(r.kind, r["pass"]): (r.n, r.n_chains) for r in sources.passes(events_, follows, 2).collect()}
    assert got == {("a", 0): (2, 2), ("b", 0): (1, 1), ("z", 0): (1, 1), ("b", 1): (2, 2), ("c", 1): (2, 2), ("d", 1): (1, 1), ("d", 2): (4, 2)}


def test_guides_are_cut_where_they_lie(spark):
    """No guide is dealt out by lines; a theme that comes back goes on with its section and knows the index of both covers."""
    text = "x\nLa cosa\fTema A.1.\n1. La cosa\n2. Altra\fabans\nLa c osa\nu\n  dos \fTema B.2.\n10. Única\n9. ÚNICA\fúnica\fTema A.1.\n3. Nova\ftres\nAltra\nIdees força\nfi\nNova\nLA COSA\nmés"
    g = laws.guide_sections(spark.createDataFrame([(7, text), (8, None), (9, "")], "id long, text string"))
    assert "Exchange" not in g._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.section, r.title, r.body) for r in g.collect()) == [
        (7, "A.1.1", "LA COSA", "u dos tres més"), (7, "A.1.2", "Altra", ""), (7, "A.1.3", "Nova", ""), (7, "A.1.IF", "Idees força", "fi"), (7, "B.2.10", "única", ""),
    ]


def test_leaves_take_no_part_in_rounds(spark, monkeypatch):
    """Uses of a b with one a are no edges of the rounds; links between a are."""
    seen = []
    monkeypatch.setattr(coverage, "components", lambda e: seen.append(sorted(map(tuple, e.collect()))) or components(e))
    rows = [(1, 101, 2), (1, 102, 3), (2, 102, 1), (5, 110, 4), (5, 111, 6), (9, 120, 1)]
    got = sorted(tuple(r) for r in coverage.component_demand(spark.createDataFrame(rows, "a long, b long, n long")).collect())
    assert got == [(1, 2, 2, 6, 3), (5, 1, 2, 10, 6), (9, 1, 1, 1, 1)] and seen == [[(2, 1)]]


def test_lines_are_counted_before_they_are_multiplied(spark):
    plan = coverage.topic_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Expand") :]
