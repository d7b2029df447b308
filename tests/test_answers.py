"""Answers and the risk register on micro tables."""

import datetime as dt

from retailops.operators import answers as A
from retailops.operators import expansion as X


def branches(spark):
    return spark.createDataFrame([("North", 1), ("North East", 2)], "branch string, list_pos int")


def test_lookup_links_names_and_marks_strangers(spark):
    table = spark.createDataFrame([("North", 5.0), ("North East", 7.0)], "branch string, v double")
    names = spark.createDataFrame([("north",), ("NORTH EAST",), ("North shop",), ("Moon",), (None,)], "name string")
    got = {r["name"]: (r["branch"], r["v"], r["found"]) for r in A.topic_lookup(names, table, branches(spark)).collect()}
    assert got == {"north": ("North", 5.0, True), "NORTH EAST": ("North East", 7.0, True),
                   "North shop": ("North", 5.0, True), "Moon": (None, None, False), None: (None, None, False)}


def test_answers_by_branch_network_and_without_topic(spark):
    q = spark.createDataFrame([(1, "Forecast demand for Hill"), (2, "forecast please"), (3, "hello"),
                               (4, "Should we expand near Hill?"), (5, "shift plan for Sea"), (6, None)],
                              "question_id int, question string")
    places = spark.createDataFrame([("Hill", 1), ("Sea", 2)], "branch string, list_pos int")
    home = spark.createDataFrame([("Hill", "North"), ("Sea", "South")], "place string, branch string")
    t = spark.createDataFrame([("demand", "North", "growing", 9.0), ("demand", None, "North", 20.0),
                               ("expansion", None, "GO", 0.8), ("full_summary", None, "GO", 20.0)],
                              "topic string, branch string, headline string, figure double")
    got = {r["question_id"]: tuple(r)[1:] for r in A.answer_questions(q, places, home, t).collect()}
    assert got == {1: ("demand", "North", "growing", 9.0), 2: ("demand", None, "North", 20.0),
                   3: ("full_summary", None, "GO", 20.0), 4: ("expansion", None, "GO", 0.8),
                   5: ("staffing", "South", None, None), 6: ("full_summary", None, "GO", 20.0)}


def test_short_history_is_a_risk_only_when_short(spark):
    scored = spark.createDataFrame([("North", 0.9, 0.1, 3)],
                                   "branch string, composite_score double, revenue_cv double, num_employees long")
    fsum = spark.createDataFrame([("North", 0.2)], "branch string, forecast_vs_historical double")
    for n, want in ((4, ["Short data history"]), (12, [])):
        months = [(b, dt.date(2024, m, 1)) for b, k in (("North", n), ("South", 12)) for m in range(1, k + 1)]
        history = X.shortest_history(spark.createDataFrame(months, "branch string, date date"))
        risks = X.risk_register(scored, fsum, history).collect()
        assert [r["risk"] for r in risks] == want
        assert all(" 4 months" in r["detail"] for r in risks)


def test_long_name_lists_give_the_same_links(spark, monkeypatch):
    """The index of grams against the array: short, empty, repeated and nested names, NULL and odd texts."""
    import random
    rng = random.Random(2)
    words = ["".join(rng.choice("abcé ") for _ in range(rng.randint(1, 9))) for _ in range(150)] + ["North", "North East", "north", "x", "", "ab"]
    names = spark.createDataFrame([(w, i) for i, w in enumerate(words)] + [(None, 900)], "branch string, list_pos int")
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 30))) for _ in range(120)] + [" NORTH east ", "Xx", "", "a", None, None]
    texts += [w.upper() for w in words[:20]] + [w[1:-1] for w in words[:20]]
    for some in (names, names.where("length(branch) > 2")):
        q = spark.createDataFrame(list(enumerate(texts)), "question_id int, question string")
        n = q.selectExpr("question as name")
        monkeypatch.setattr(A, "LISTED", 10_000)
        want = [sorted(map(str, of.collect())) for of in (A.extract_branch(q, some), A.link_branch(n, some))]
        monkeypatch.setattr(A, "LISTED", 3)
        assert [sorted(map(str, of.collect())) for of in (A.extract_branch(q, some), A.link_branch(n, some))] == want


def test_a_hundred_thousand_names(spark):
    """No array holds the names: every question finds the one it names, and the plan hints no broadcast."""
    names = spark.range(100_000).selectExpr("concat('place ', hex(id * 7919 + 1000000), ' end') as branch", "cast(id as int) as list_pos")
    q = spark.range(0, 100_000, 37).selectExpr("id as question_id", "concat('Staff for PLACE ', hex(id * 7919 + 1000000), ' End next week?') as question")
    got = A.extract_branch(q, names)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint" not in got._jdf.queryExecution().optimizedPlan().toString()
    wrong = got.where("branch is null or branch <> concat('place ', hex(question_id * 7919 + 1000000), ' end')")
    assert got.count() == q.count() and wrong.count() == 0
    linked = A.link_branch(q.selectExpr("question as name").limit(50), names)
    assert linked.where("branch is null").count() == 0
