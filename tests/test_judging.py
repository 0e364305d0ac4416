from conftest import SF
from pyspark.sql import functions as F

from tidewell.catalog import CORE
from tidewell.operators import content, judging, review

TEXT = "Una situacion que se describe con bastantes palabras para que llegue a la longitud debida de un caso"


def scenario(**changes):
    base = {
        "competency": "a", "format": "ranking", "difficulty": 2, "situation": TEXT, "question": "Que haria usted ahora", "rationale": TEXT,
        "options": [(f"option {i}", p) for i, p in enumerate(({"a": 2, "b": 2}, {"a": 2, "b": 1}, {"a": 2}, {"b": 1}))], "expected": ["a", "b"], "recommended": [0, 1, 2, 3], "fields": ["situation"],
    }
    return {**base, **changes}


SCHEMA = "competency string, format string, difficulty int, situation string, question string, rationale string, options array<struct<text:string,points:map<string,int>>>, expected array<string>, recommended array<int>, fields array<string>"


def test_scenario_rules_one_by_one(spark):
    four = scenario()["options"]
    cases = [
        ({}, []), ({"fields": ["verdict", "x"]}, ["reserved field"]), ({"format": "otro"}, ["format"]), ({"difficulty": None}, ["difficulty"]), ({"question": "short"}, ["question too short"]), ({"situation": None}, ["situation too short"]),
        ({"competency": "z"}, ["competency not official", "own competency has no points", "expected competencies"]), ({"options": four[:3]}, ["four different options"]), ({"options": None}, ["four different options"]), ({"options": [four[0]] * 4}, ["four different options"]),
        ({"options": [*four[:3], ("o", {"b": 3})]}, ["points", "order against points"]), ({"options": [("o", {"q": 1}), *four[1:]]}, ["points", "own competency has no points", "expected competencies", "order against points"]),
        ({"expected": ["b"]}, ["expected competencies"]), ({"expected": None}, ["expected competencies"]), ({"recommended": [0, 1, 1, 3]}, ["recommended order"]), ({"recommended": None}, ["recommended order"]), ({"recommended": [1, 0, 2, 3]}, ["order against points"]),
        ({"format": "eleccion"}, []), ({"format": "eleccion", "options": [*four[:3], ("o", {"a": 2, "b": 2})]}, ["best option not unique"]), ({"rationale": TEXT + " Garantiza la plaza"}, ["forbidden claim"]), ({"rationale": TEXT + " diagnósticos"}, []),
    ]
    names = SCHEMA.split(", ")
    rows = [tuple(scenario(**c)[n.split()[0]] for n in names) for c, _ in cases]
    got = spark.createDataFrame(rows, SCHEMA).select(judging.scenario_findings(["a", "b"]).alias("f")).collect()
    assert [(c, r.f) for (c, _), r in zip(cases, got, strict=True)] == [(c, f) for c, f in cases]


def test_repeated_situations(spark):
    words = "alfa beta gamma delta epsilon zeta omega kappa".split()
    words = [w + "xx" for w in words]
    rows = [(1, "b", " ".join(words)), (2, "b", " ".join(words[:6])), (3, "c", " ".join(words)), (4, "b", " ".join(words[:3])), (5, "b", None), (6, "b", ""), (7, "b", " ".join(words[:4]) + " other")]
    got = {r.id: r.repeats for r in judging.repeated_situations(spark.createDataFrame(rows, "id long, batch string, situation string")).collect()}
    assert got == {2: 1, 4: 2, 7: 2}


def test_transcripts(spark):
    text = lambda t: f'{{"message":{{"role":"assistant","content":[{{"type":"text","text":"{t}"}}]}}}}'
    call = lambda m: '{"message":{"role":"assistant","content":[{"type":"tool_use","name":"SubagentHandback","input":{' + (f'"message":"{m}"' if m else "") + "}}]}}"
    rows = [(1, 0, text("a")), (1, 1, text("b")), (1, 2, text(" ")), (2, 0, call("done")), (2, 1, text("after")), (3, 0, call("done")), (3, 1, call("")), (3, 2, text("last")), (4, 0, "{broken"), (5, 0, None), (6, 0, '{"message":{"role":"assistant","content":"plain"}}'), (7, 0, text("x").replace("assistant", "user"))]
    got = {r.transcript: (r.n_calls, r.tools, r.final) for r in judging.read_transcripts(spark.createDataFrame(rows, "transcript long, pos long, line string")).collect()}
    assert got == {1: (0, "", "b"), 2: (1, "SubagentHandback", "done"), 3: (2, "SubagentHandback", "last"), 4: (0, "", None), 5: (0, "", None), 6: (0, "", None), 7: (0, "", None)}


def test_policies(spark):
    v = spark.createDataFrame([("r", 1, "one"), ("r", 2, "two"), ("s", 1, "only")], "registry string, version long, content string").withColumn("hash", F.sha2("content", 256))
    frozen = judging.freeze(spark.createDataFrame([("r", 1), ("s", 2), ("t", 3)], "registry string, batch long"), v)
    assert {(r.batch, r.frozen_version) for r in frozen.collect()} == {(1, 2), (2, 1), (3, None)}
    incidents = lambda known: {r.batch: r.incident for r in judging.verify(frozen, known).collect()}
    assert incidents(v) == {1: None, 2: None, 3: "batch without policy"}
    assert incidents(v.withColumn("content", F.lit("x")))[1] == "policy altered"
    assert incidents(v.where("version < 2"))[1] == "unknown version"
    again = v.withColumn("content", F.concat("content", F.lit("!"))).withColumn("hash", F.sha2("content", 256))
    assert incidents(again)[1] == "not the frozen policy"
    proposals = spark.createDataFrame([("r", "three"), ("s", "new"), ("u", "first")], "registry string, content string")
    made = judging.bump(v, proposals, frozen.where("registry = 's'"))
    assert {(r.registry, r.version, r.hash is None) for r in made.collect()} == {("r", 3, False), ("s", None, True), ("u", 1, False)}
    newer = v.unionByName(made.where("registry = 'r'").join(proposals, "registry").select("registry", "version", "content", "hash"))
    assert incidents(newer)[1] == "active version changed"


def test_every_outcome_occurs(spark):
    found = {r.incident for r in CORE["policy_verification"].build(spark, "/root/testdata/sf0.01").collect()}
    assert found >= {None, "batch without policy", "policy altered", "not the frozen policy", "active version changed"}
    rows = CORE["scenario_rules"].build(spark, SF).collect()
    seen = {x for r in rows for x in r.findings.split("; ")}
    assert any(r.passes for r in rows) and len(seen) >= 10, seen


def test_copies_repeat_the_first(spark):
    words = [w + "xx" for w in "alfa beta gamma delta epsilon zeta omega kappa".split()]
    rows = [(i, "b", " ".join(words)) for i in range(3, 40)] + [(2, "b", " ".join(words[:5])), (50, "b", " ".join(reversed(words[:5]))), (60, "c", " ".join(words))]
    got = judging.repeated_situations(spark.createDataFrame(rows, "id long, batch string, situation string"))
    assert {r.id: r.repeats for r in got.collect()} == {**{i: 2 for i in range(3, 40)}, 50: 2}


def test_pairs_are_compared_where_they_meet(spark):
    """After the join of prefixes no pair is dealt out again to make pairs distinct."""
    sets = spark.createDataFrame([(i, 0, [f"w{i % 3}", "x", f"y{i % 5}"]) for i in range(30)], "id long, block int, words array<string>")
    pairs = content.prefix_pairs(sets, "block", 0.5)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join Inner")]
    rows = pairs.collect()
    w = {r.id: set(r.words) for r in sets.collect()}
    assert sorted((r.a, r.b) for r in rows) == [(a, b) for a in range(30) for b in range(a + 1, 30) if len(w[a] & w[b]) >= 0.5 * len(w[a] | w[b])]


def test_decisions_on_copies(spark):
    """Copies count once as items that decide, and up to five as suspects; they themselves are exact repeats of the first."""
    item = lambda i, stem, right: (i, "s", stem, [right, "b", "c", "d"], 0)
    rows = [item(i, "uno dos tres cuatro", "x") for i in range(1, 9)] + [item(9, "uno dos tres cinco", "y"), item(10, "uno dos tres cuatro", "z"), item(11, "uno siete ocho nueve", "x"), item(0, "uno dos tres cinco seis", "w")]
    df = spark.createDataFrame(rows, "id long, section string, stem string, options array<string>, answer int")
    got = {r.id: (r.decision, r.duplicate_of, r.suspects) for r in review.duplicate_decisions(df).collect()}
    assert got == {1: ("suspect", None, "0"), **{i: ("exact", 1, None) for i in range(2, 9)}, 9: ("suspect", None, "0,1,2,3,4"), 10: ("suspect", None, "1,2,3,4,5")}


def test_signals_are_read_where_answers_meet(spark):
    """Pairs of items aren't made distinct or joined with their texts after they met; a share of 0.495 counts as half."""
    word = lambda k: f"palabra{k}"
    text = lambda ks: " ".join(map(word, ks))
    rows = [(1, "A.1.1", "primera", [text(range(200))], 0, text(range(300, 310))), (2, "A.1.2", "segunda", [text([*range(99), *range(400, 502)])], 0, text(range(300, 310))), (3, "A.1.2", "tercera", [text(range(49))], 0, text(range(90, 95)))]
    items = spark.createDataFrame(rows, "id long, place string, stem string, options array<string>, answer int, quote string")
    signals = review.three_signals(items)
    plan = signals._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join Inner")]
    assert [(r.earlier, r.id, r.answer, r.verdict) for r in signals.orderBy("id", "earlier").collect()] == [(1, 2, 0.5, "suspect"), (1, 3, 1.0, "suspect"), (2, 3, 1.0, "suspect")]


def test_decisions_settle_what_they_are_made_of(spark):
    """No text form and no join of pairs stands in the plan of the decisions, where each reader would make it again."""
    rows = [(i, "s", f"uno dos tres {i}", [f"{i % 3}", "b", "c", "d"], 0) for i in range(6)]
    got = review.duplicate_decisions(spark.createDataFrame(rows, "id long, section string, stem string, options array<string>, answer int"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "array_intersect" not in plan
    # the left join of copies and that of suspects with copies
    assert plan.count("Join ") == 2
    # a settled table is larger than its files say: none goes through the driver
    assert plan.count("strategy=merge") == 2 and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_all_suspects_are_kept(spark):
    """The query has no number of suspects at which it stops; copies of a suspect are among them, nearest first."""
    item = lambda i, stem, right: (i, "s", stem, [right, "b", "c", "d"], 0)
    rows = [item(i, "uno dos tres cuatro", f"x{i}") for i in range(1, 9)] + [item(i, "uno dos tres cinco", "y") for i in range(9, 19)] + [item(30, "uno dos tres cinco", "z")]
    df = spark.createDataFrame(rows, "id long, section string, stem string, options array<string>, answer int")
    got = {r.id: (r.decision, r.suspects) for r in review.duplicate_decisions(df, nearest=None).collect()}
    ids = lambda *parts: ",".join(str(i) for p in parts for i in p)
    assert got == {**{i: ("suspect", ids(range(1, i))) for i in range(2, 9)}, 9: ("suspect", ids(range(1, 9))), **{i: ("exact", None) for i in range(10, 19)}, 30: ("suspect", ids(range(9, 19), range(1, 9)))}


def test_example_items_keep_all_suspects(spark, tmp_path):
    """Texts of which every tenth gives a stem of one word and an answer of its own: each such item has all earlier ones."""
    ids = range(10, 200, 10)
    spark.createDataFrame([(i, f"Uno. Dos {i}. Tres {i}. Cuatro {i}. Final") for i in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: r.suspects for r in review.duplicate_decision(spark, str(tmp_path)).where("decision = 'suspect'").collect()}
    assert max(len(s.split(",")) for s in got.values()) > review.SUSPECTS


def test_one_answer_of_many_items_is_met_in_cells(spark):
    """Items of one answer are dealt over the cells of a grid, so that no task has all their pairs; each pair is met once."""
    rows = spark.range(60).selectExpr("id", "'k' AS w", "'x' AS a")
    left, right = content.in_cells(rows.withColumnRenamed("id", "l"), rows.withColumnRenamed("id", "r").drop("a"), ["w"], "l", "r", 400)
    met = left.join(right, ["w", "i", "j"])
    assert met.count() == met.select("l", "r").distinct().count() == 3600
    assert met.select("i", "j").distinct().count() == 9


def test_signals_make_forms_and_answers_once(spark):
    """No text form stands in the plan of the pairs; what a pair shares isn't made again where it is asked for."""
    items = spark.createDataFrame([(i, "A.1.1", f"stem palabra{i}", ["palabra otra", "b"], 0, "esta misma cita") for i in range(5)], "id long, place string, stem string, options array<string>, answer int, quote string")
    signals = review.three_signals(items)
    plan = signals._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("array_intersect") == 3
    assert signals.count() == 10
