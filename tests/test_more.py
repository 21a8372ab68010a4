"""Calibration, insights, resume parts and store operations that have no SQL of their own, and operators that only queries used."""

import math
import random

from pyspark.sql import functions as F

from brightloom.functions import text as T
from brightloom.operators import calibration as K
from brightloom.operators import claims as C
from brightloom.operators import evaluation as E
from brightloom.operators import evidence as V
from brightloom.operators import funnel as N
from brightloom.operators import insights as I
from brightloom.operators import matching as M
from brightloom.operators import pages as G
from brightloom.operators import records as R
from brightloom.operators import resumes as B
from brightloom.operators import skills as S
from brightloom.sources import entries


def descent(rows, l2, steps, rate):
    n, w, b = len(rows), [0.0] * 5, 0.0
    for _ in range(steps):
        errors = [1 / (1 + math.exp(-(b + sum(a * c for a, c in zip(w, x, strict=True))))) - y for x, y in rows]
        w = [a - rate * (sum(e * x[k] for e, (x, _) in zip(errors, rows, strict=True)) / n + l2 * a) for k, a in enumerate(w)]
        b -= rate * sum(errors) / n
    return b, w


def test_calibration_equals_descent(spark):
    rng = random.Random(7)
    rows = [([round(rng.random(), 2) for _ in K.FEATURES], 0) for _ in range(300)]
    rows = [(x, int(x[0] + x[1] > 1.0)) for x, _ in rows]
    table = spark.createDataFrame([(*x, y) for x, y in rows] + [(None, 0.1, 0.1, 0.1, 0.1, 1), (0.1, 0.1, 0.1, 0.1, 0.1, None)], ", ".join(f"{f} double" for f in K.FEATURES) + ", y int")
    found = K.fit(table, F.col("y") == 1)
    b, w = descent(rows, K.RIDGE, 3000, 2.0)
    assert abs(found.intercept - b) < 2e-3 and all(abs(v - a) < 2e-3 for (_, v), a in zip(found.weights, w, strict=True)) and found.pairs == 300
    assert dict(found.weights)["skills"] > 1 and abs(dict(found.weights)["semantic"]) < 1
    ones = {f: F.lit(1.0) for f in K.FEATURES}
    assert spark.range(1).select(found.apply(ones).alias("p")).first().p > 0.9
    few = K.Calibration(found.intercept, found.weights, 10)
    other = K.Calibration(0.0, (("skills", 1.0),), 999)
    assert K.usable(found) is found and K.usable(few) is K.usable(other) is K.usable(None) is None
    score = lambda c: spark.range(1).select(M.total_score(ones, F.lit(0.0), F.lit(False), c).alias("s")).first().s
    assert score(few) == score(None) == 100 and score(found) == round(100 / (1 + math.exp(-(found.intercept + sum(v for _, v in found.weights)))))
    assert K.fit(table.limit(0), F.col("y") == 1) is None


def test_insights_of_nothing(spark):
    from brightloom.plans.scoring import TAX

    rows = spark.createDataFrame([], "id string, source string, company string, title string, location string, description string")
    profile = M.Profile((), 0.0, "text")
    found = [(r.kind, r.text) for r in I.insights(M.scored(rows, TAX, profile), profile).collect()]
    assert found == [("strength", "No strong overlaps found yet — see the skills to build below.")]


def test_projects_and_certificates(spark):
    text = "Jane\nProjects\n- A first bullet names one\n• point\nEngine\nEducation\nBSc in Law & Order, Rome University, 2003\nCertifications:\nCKA\n\n- AWS"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Projects")], "id int, text string")
    assert [(r.id, r.project, r.name, r.bullets) for r in B.projects(rows).orderBy("project").collect()] == [(1, "p1", "A first bullet names one", ["point"]), (1, "p2", "Engine", [])]
    assert [(r.n, r.text) for r in B.certifications(rows).orderBy("n").collect()] == [(1, "CKA"), (2, "AWS")]
    assert [r.field for r in B.fields_of_study(rows).collect()] == ["Law & Order"]


def test_of_repeated_arrivals_the_first(spark):
    schema = "item int, label string, at int"
    stored, new = spark.createDataFrame([(1, "a", 0)], schema), spark.createDataFrame([(1, "b", 1), (2, "z", 3), (2, "y", 5), (2, "y", 4), (None, "n", 1), (None, "n", 1)], schema)
    by_time = sorted(map(str, R.inserted_once(stored, new, ["item"], F.col("at")).collect()))
    assert by_time == sorted(["Row(item=1, label='a', at=0)", "Row(item=2, label='z', at=3)"] + ["Row(item=None, label='n', at=1)"] * 2)
    assert {r.at for r in R.inserted_once(stored, new, ["item"], -F.col("at")).where("item = 2").collect()} == {5}


def test_operators_that_had_no_test(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.urls_in(F.lit("See https://a.b/c, (http://d.e) and https://a.b/c."))) == ["https://a.b/c", "http://d.e"]
    assert str(one(T.parse_date(F.lit("Wed, 01 May 2024 10:00:00 GMT")))) == "2024-05-01 10:00:00"
    assert [one(R.nearest_rank(F.lit([3, 1, 2, 4]), p)) for p in (0.0, 0.25, 0.5, 1.0)] == [1, 2, 3, 4]
    a, b = (one(C.request_key(parts)) for parts in ({"q": F.lit("x"), "n": F.lit(1)}, {"n": F.lit(1), "q": F.lit("x")}))
    assert a == b != one(C.request_key({"q": F.lit("y"), "n": F.lit(1)}))
    rows = spark.createDataFrame([(1, "u:1"), (2, None)], "id int, owner string")
    assert [r.owner for r in R.reassigned(rows, "owner", F.lit(None).cast("string"), "u:9").orderBy("id").collect()] == ["u:1", "u:9"]
    picked = spark.createDataFrame([("p", 1.0), ("q", 2.0)], "id string, score double")
    assert [(r["rank"], r.job_id) for r in R.ranked_results(picked, "s", [F.desc("score")]).orderBy("rank").collect()] == [(0, "q"), (1, "p")]
    query = N.Query(title="ML Engineer", now="2024-05-01", alternatives=("Applied Scientist",), excluded=("Sales Engineer",))
    jobs = spark.createDataFrame([(str(k), "lever", t, "") for k, t in enumerate(["Applied Scientist II", "ML Sales Engineer"])], "id string, source string, title string, description string").selectExpr("*", "'' as location", "true as remote", "null as posted", "'' as employment_type")
    assert [r.relevance for r in N.tagged(jobs, query).orderBy("id").collect()] == [1.0, 0.0]


def test_logs_only_grow(spark, tmp_path):
    for n in (2, 3):
        R.append_log(spark.range(n), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 5


def test_a_person_overrides_a_judgment(spark):
    from brightloom.plans.scoring import TAX

    text = "We are a circus of forty people that tours the whole country every year.\nRequirements\n- Juggling burning torches\n- Python"
    rows = spark.createDataFrame([("a", "s", "c", "Juggler", "", text)], "id string, source string, company string, title string, location string, description string")
    scores = M.scored(rows, TAX, M.Profile(("Python",), 3.0, "Python"))
    told = spark.createDataFrame([("a", "Juggling burning torches", "met", True)], "id string, text string, status string, verified boolean")
    own = spark.createDataFrame([("a", "Juggling burning torches")], "id string, text string")
    plain, judged, overridden = scores.first().score, V.combined(scores, told).first(), V.combined(scores, told, own).first()
    assert judged.final_score > plain - 2 and overridden.final_score < judged.final_score and (judged.verified, overridden.verified) == (1, 1)


def test_pages_that_need_a_visit(spark):
    rows = spark.createDataFrame([(1, "", False, "$1"), (2, "x" * 9000, False, "$1"), (3, "x" * 9000, True, "$1"), (4, "x" * 9000, None, ""), (5, None, None, None)], "k int, d string, t boolean, s string")
    found = {r.k: r.n for r in rows.select("k", G.needs_enrichment(F.col("d"), F.col("t"), F.col("s")).alias("n")).collect()}
    assert found == {1: True, 2: False, 3: True, 4: True, 5: True}
    html = '<html><head><script type="application/ld+json">{"@type":"JobPosting","title":"Nurse","hiringOrganization":"City","description":"Care for people"}</script></head></html>'
    urls = spark.createDataFrame([(0, " https://a.example.org/1 "), (1, "https://a.example.org/2"), (2, "http://localhost/x"), (3, ""), (4, "https://a.example.org/1"), (5, "https://a.example.org/3")], "pos int, url string")
    pages = spark.createDataFrame([("https://a.example.org/1", html), ("https://a.example.org/2", "<title>x</title>"), ("http://localhost/x", html)], "url string, html string")
    told = {r.url: (r.ok, r.title, r.message) for r in G.import_results(urls, pages).collect()}
    assert told["https://a.example.org/1"] == (True, "Nurse", "") and told["https://a.example.org/2"] == (False, "", "no posting found") and told["https://a.example.org/3"] == (False, "", "no page")
    assert not told["http://localhost/x"][0] and told["http://localhost/x"][2] and len(told) == 4


def test_unknown_quality_is_last(spark):
    board = spark.createDataFrame([("s", "a", None), ("s", "b", 0.1), ("r", "c", 0.0), ("s", "d", 0.9)], "suite string, model string, quality double")
    assert [r.model for r in E.board_order(board).orderBy("place").collect()] == ["c", "d", "b", "a"]


def test_cases_of_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "tags": ["x"]}\n\nnot json\n{"id": 2}\n{"id": "three"\n', encoding="utf-8")
    cases, broken = entries.read_cases(spark, str(tmp_path), "id int, tags array<string>")
    assert [(r.id, r.tags) for r in cases.orderBy("id").collect()] == [(1, ["x"]), (2, None)]
    assert sorted((r.file, r.line) for r in broken.collect()) == [("a.jsonl", "not json"), ("a.jsonl", '{"id": "three"')]


def test_samples_and_typed_rows(spark):
    rows = spark.createDataFrame([("1", "Data Engineer", ""), ("2", "Nurse", ""), ("3", "Senior Data Engineer", ""), ("4", None, None)], "id string, title string, description string")
    assert [(r.place, r.id) for r in entries.samples(rows, "Data Engineer").orderBy("place").collect()] == [(1, "1"), (2, "3"), (3, "2"), (4, "4")]  # fewer than four fit
    more = rows.unionByName(rows.where("id in ('1', '3')").selectExpr("concat(id, 'x') as id", "title", "description"))
    assert {r.id for r in entries.samples(more, "Data Engineer").collect()} == {"1", "3", "1x", "3x"}
    typed = spark.createDataFrame([(2, " Cook ", None, "Rome", "", "x "), (1, "Nurse", "City", None, None, None)], "pos int, title string, company string, location string, url string, description string")
    assert [tuple(r) for r in entries.manual(typed).orderBy("id").collect()] == [("manual-1", "manual", "Nurse", "City", "", "", ""), ("manual-2", "manual", "Cook", "", "Rome", "", "x")]
    assert entries.manual(typed.limit(0)).count() == 0


def test_joined_mentions_with_many_first_words(spark):
    rows = spark.createDataFrame([(1, "We use SQL, no Apache Spark"), (2, None)], "id int, description string")
    aliases = spark.createDataFrame([("Spark", "", "apache spark", None), ("SQL", "", "sql", None)], "skill string, category string, alias string, context array<string>")
    for most in (10, 1):
        assert {tuple(r) for r in S.mentions_joined(rows, aliases, most_firsts=most).collect()} == {(1, "SQL", False), (1, "Spark", True)}
