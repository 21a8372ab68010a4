"""Cases that once went wrong."""

import pytest
from pyspark.sql import functions as F

from brightloom.functions import phrases as W
from brightloom.operators import evaluation as E
from brightloom.operators import profiles as P
from brightloom.operators import records as R
from brightloom.operators import requirements as Q
from brightloom.sources import feeds


def test_a_failed_report_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "report")
    assert R.read_report(spark, path) is None
    rows = spark.createDataFrame([(1, "=1+1"), (2, 'say "x", \n y'), (3, None)], "id int, cell string")
    for kind in ("csv", "json"):
        at = f"{path}-{kind}"
        R.write_report(rows, at, kind)
        with pytest.raises(Exception, match="no luck"):
            R.write_report(rows.withColumn("cell", F.raise_error(F.lit("no luck")).cast("string")), at, kind)
        kept = {r.id: r.cell for r in R.read_report(spark, at, kind, "id int, cell string").collect()}
        assert kept == {1: "'=1+1" if kind == "csv" else "=1+1", 2: 'say "x", \n y', 3: None}
        for n in (5, 6, 7):
            R.write_report(rows.limit(1).withColumn("id", F.lit(n)), at, kind)
        assert [r.id for r in R.read_report(spark, at, kind, "id int, cell string").collect()] == [7]
        assert sum(p.is_dir() for p in (tmp_path / f"report-{kind}").iterdir()) == 2  # older versions and failed ones go


def test_majority_of_equal_counts_is_the_first_by_name(spark):
    rows = [("x", "m1", "b"), ("x", "m2", "aa"), ("y", "m1", "same-prefix-2"), ("y", "m2", "same-prefix-1"), ("z", "m1", "q"), ("z", "m2", "q"), ("z", "m3", "a")]
    found = {r.item: r.majority for r in E.label_agreement(spark.createDataFrame(rows, "item string, model string, label string")).collect()}
    assert found == {"x": "aa", "y": "same-prefix-1", "z": "q"}


def test_repeated_keys_stay_one_row(spark):
    schema = "id int, feature string, last_seen int, first_seen int"
    stored = spark.createDataFrame([(1, "a", 1, 1), (2, "b", 1, 1), (2, "b", 1, 1), (None, "n", 1, 1)], schema)
    new = spark.createDataFrame([(1, None, 5, 5), (1, "z", 4, 4), (3, "c", 2, 2), (3, "c", 2, 2), (None, "m", 2, 2)], schema)
    found = R.upsert(stored, new, "id", ["first_seen"], ["feature"], F.col("last_seen")).collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted([(1, "a", 5, 1), (2, "b", 1, 1), (3, "c", 2, 2), (None, "n", 1, 1), (None, "m", 2, 2)], key=str)
    posting = spark.createDataFrame([("p", "short", "", "u", "")], "id string, description string, location string, url string, employment_type string")
    details = spark.createDataFrame([("p", "a longer text", "Rome", "", None), ("p", "a long text", "Oslo", "v", "Contract"), (None, "x", "x", "x", "x")], posting.schema)
    assert [tuple(r) for r in feeds.with_details(posting, details).collect()] == [("p", "a longer text", "Rome", "u", "")]


def test_one_rule_of_degrees(spark):
    assert P.education_level is Q.education_level
    row = spark.createDataFrame([("Certified Scrum Master",)], "t string").select(P.education_level(F.col("t")).alias("e")).first()
    assert row.e is None


def test_headers_know_all_role_words(spark):
    rows = spark.createDataFrame([("Acme Corp, Accountant",), ("Big Bank | Financial Advisor",), ("Chef at Trattoria",)], "text string")
    found = [tuple(r) for r in rows.select(W.header_parts(F.col("text")).alias("h")).select("h.title", "h.company").collect()]
    assert found == [("Accountant", "Acme Corp"), ("Financial Advisor", "Big Bank"), ("Chef", "Trattoria")]


def test_what_is_kept_follows_its_inputs(spark, tmp_path):
    from brightloom.durable import kept

    made = []
    path = str(tmp_path / "t.parquet")

    def make():
        made.append(1)
        return spark.read.parquet(path).selectExpr("sum(id) as s")

    spark.range(4).write.parquet(path)
    assert [kept(spark, "a", [path], make).first().s for _ in range(3)] == [6, 6, 6] and len(made) == 1
    assert kept(spark, "b", [path], make).first().s == 6 and len(made) == 2
    spark.range(9, 11).write.mode("append").parquet(path)
    assert kept(spark, "a", [path], make).first().s == 25 and len(made) == 3


def test_discarded_files_go_at_once(spark):
    import os

    from brightloom.durable import discard, durable

    first = durable(spark.range(3))
    second = durable(first.selectExpr("id + 1 as id"))
    path = first.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path)
    discard(first, None, spark.range(2), second.where("id > 1"))
    assert not os.path.isdir(path) and second.count() == 3


def counted(spark, column):
    """The column through a function that counts its calls, and the counter."""
    calls = spark.sparkContext.accumulator(0)

    def told(x):
        calls.add(1)
        return x

    return F.udf(told, "string")(column), calls


@pytest.mark.parametrize("plan", ["all_drops", "funnel_counts", "funnel"])
def test_postings_are_tagged_once(spark, plan):
    from brightloom.operators import funnel as N

    rows = [(str(k), "lever", f"Acme {k % 3}", "Data Engineer" if k % 2 else "Nurse", "Berlin", f"text {k}") for k in range(40)]
    df = spark.createDataFrame(rows, "id string, source string, company string, title string, location string, description string")
    title, calls = counted(spark, F.col("title"))
    df = df.withColumns({"title": title, "remote": F.lit(None).cast("boolean"), "url": F.lit(None).cast("string"), "posted": F.lit(None).cast("timestamp"), "employment_type": F.lit("")})
    found = getattr(N, plan)(df, N.Query(title="Data Engineer", now="2024-05-01", count=2)).collect()
    assert calls.value == 40
    if plan == "all_drops":
        assert {tuple(r) for r in found} == {("lever", "title", 20), ("lever", "duplicate", 17), ("lever", "over_limit", 1)}


@pytest.mark.parametrize("classes", ["near_classes", "greedy_classes"])
def test_classes_broadcast_no_hashes(spark, classes):
    from brightloom.operators import near as N

    table = spark.createDataFrame([("x", k, (k * 0x9E3779B97F4A7C15 >> 3) % (1 << 62)) for k in range(1, 60)] + [("x", 60, 7), ("x", 61, 6)], "block string, id long, simhash long")
    found = N.near_classes(table, ["block"]) if classes == "near_classes" else N.greedy_classes(table, ["block"], [F.col("id")])
    plan = found._jdf.queryExecution()
    assert len(found.collect()) == 61
    assert "Join" in plan.executedPlan().toString() and "Broadcast" not in plan.executedPlan().toString()


def test_lines_of_all_blocks_are_made_once(spark):
    from brightloom.operators import embedding as B

    line, calls = counted(spark, F.concat(F.lit("shipped green steel parts "), F.col("id").cast("string")))
    lines = spark.range(30).select(F.col("id").alias("line_no"), line.alias("line"))
    texts = spark.createDataFrame([("shipped green steel parts 17",), ("parts",)], "text string")
    found = {r.text: r.line_no for r in B.best_lines(texts, lines, B.embedder("md5"), block=4).collect()}
    assert found["shipped green steel parts 17"] == 17 and len(found) == 2 and calls.value <= 60  # for the filter, and for the written row
