"""Lines of texts: worked out once each, and the same as with the whole text."""

import random

import pytest
from pyspark.sql import functions as F

from brightloom.durable import durable
from brightloom.functions import values as V
from brightloom.functions.text import terms
from brightloom.operators import gates as G
from brightloom.operators import matching as M
from brightloom.operators import requirements as Q
from brightloom.operators import skills as S

TAX = S.Taxonomy.of([
    ("Python", "Languages", "python", None), ("Java", "Languages", "java", None), ("Spark", "Data", "spark", ["pipelines", "data", "scala"]), ("Spring", "Web", "spring", ["java", "boot"]),
    ("Ruby", "Languages", "ruby", ["rails"]), ("CI/CD", "Platform", "ci/cd", None),
])
LINES = [
    "", " ", "Requirements", "Nice to have", "Nice\nto have", "About us", "• 5+ years of experience with Python", "spring", "Spring term", "winter of", "2024 intake", "'24 java", "boot data", "• Spark", "scala", "• Ruby", "rails",
    "• Java is not required", "no", "• ci/cd or java", "right to", "work in Germany", "fluent in German", "degree preferred", "10", "years of experience", "on-site only", "TS/SCI clearance", "no visa", "sponsorship", "•", "steel pipelines\r",
    "We are a company. We build data pipelines for customers and steel parts with a long line of prose that goes on. Experience with python is a must. You must know java; ability to learn",
]
PROFILE = M.Profile(("Python",), 3.0, "Python for data\nsteel pipelines too")


def texts_of(spark, n):
    r = random.Random(5)
    rows = [(str(k).encode(), r.choice(["Spring boot", "Data Engineer", "", "Spark\nScala", "java"]), "\n".join(r.choice(LINES) for _ in range(r.randint(0, 12))), 1) for k in range(n)]
    return durable(spark.createDataFrame(rows, "_text binary, title string, description string, copies long").repartition(4))


@pytest.mark.parametrize("hot", [{}, {"most": 3}, {"most": 0}])
def test_lines_by_themselves_say_what_the_whole_text_says(spark, hot):
    texts = texts_of(spark, 400)
    plain = lambda c: F.transform(c, lambda h: F.struct("_text", h["skill"], h["line"], h["negated"]))
    parts = M.text_parts(texts, TAX, PROFILE, **hot)
    found = parts.select("_text", plain("hits").alias("hits"), F.transform("title_hits", lambda h: F.struct(h["skill"], h["negated"])).alias("title_hits"), "terms", F.transform("lines", lambda x: F.struct(x["text"], x["preferred"], x["line"])).alias("lines"), G.detected(F.col("description"), F.col("title"), None, F.col("anchored"), F.col("title_anchored")).alias("gates"))
    hits = lambda c: S.hits_in(S.words_of(F.col(c)), TAX)
    whole = durable(texts.withColumns({"h": hits("description"), "t": hits("title")}))
    wanted = whole.select("_text", plain("h").alias("hits"), F.transform("t", lambda h: F.struct(h["skill"], h["negated"])).alias("title_hits"), terms(F.col("description"), V.STOP).alias("terms"), Q.requirement_lines(F.col("description"), F.transform("h", lambda h: h["line"])).alias("lines"), G.detected(F.col("description"), F.col("title")).alias("gates"))
    rows = lambda df: {bytes(r["_text"]): [str([tuple(x) if isinstance(x, tuple) else x for x in v]) for v in r[1:]] for r in df.collect()}
    names = lambda told: {k: [x.replace("col1", "").replace("col2", "") for x in v] for k, v in told.items()}
    assert len(rows(wanted)) == 400 and names(rows(found)) == names(rows(wanted))


def test_a_line_of_many_texts_is_searched_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    def told(x):
        calls.add(1)
        return x

    plain = S.words_of
    monkeypatch.setattr(S, "words_of", lambda text: plain(F.udf(told, "string")(text)))
    lines = ["• Python and java", "• Degree", "We build pipelines", "• Docker", "Requirements", "• 5 years"]
    rows = [(str(k), "s", "c", "l", "Engineer", "\n".join(lines[k // 6**j % 6] for j in range(4))) for k in range(600)]  # no two texts alike
    df = spark.createDataFrame(rows, "id string, source string, company string, location string, title string, description string")
    assert M.scored(df, TAX, PROFILE).count() == 600
    assert 0 < calls.value <= 3 * 7
