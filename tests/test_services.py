"""Embedders, term weights, token buckets, intents, edits, nested values, suites, feeds and orders against plain Python."""

import hashlib
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.operators import edits as D
from brightloom.operators import embedding as B
from brightloom.operators import funnel as N
from brightloom.operators import intent as I
from brightloom.operators import limits as L
from brightloom.operators import matching as M
from brightloom.operators import nested as J
from brightloom.operators import ordering as O
from brightloom.operators import suites as U
from brightloom.operators import tables as T
from brightloom.operators import vectors as X
from brightloom.sources import feeds, plugin
from brightloom.streaming import limits as stream_limits

LINES = ["Built analytical dashboards in Python for managers", "Ran a bakery with five ovens and staff", "Python", "Designed relational database schemas daily", "Built analytical dashboards in Python for managers"]


def plain_vector(text, dim):
    """Words, pairs and four-letter runs hashed with BLAKE2, one by one."""
    stop = set("a an the and or of in on to with for at by from as is are be we you our your this that will have has using use experience strong ability skills skill work working years year".split())
    words, vector = [], [0.0] * dim
    for w in "".join(c if c.isascii() and (c.isalnum() or c in "+#") else " " for c in text.lower()).split():
        if w not in stop:
            for e in ("ations", "ation", "ings", "ing", "ies", "es", "ed", "s", "al", "ly"):
                if w.endswith(e) and len(w) - len(e) > 3:
                    w = w[: -len(e)]
                    break
            words.append(w)
    told = [("w:" + w, 1.0) for w in words] + [(f"b:{words[k]}_{words[k + 1]}", 0.7) for k in range(len(words) - 1)]
    for w in words:
        told += [("c:" + f"#{w}#"[k : k + 4], 0.25) for k in range(max(1, len(w) - 1))]
    for feature, weight in told:
        v = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
        vector[v % dim] += weight if v >= 1 << 63 else -weight
    norm = math.sqrt(sum(x * x for x in vector)) or 1.0
    return [x / norm for x in vector]


def test_vectors_equal_plain_python(spark):
    texts = [None, "", "the and of", "Analytics, analytical C++ dashboards", "a1 b2#", "naïve – words"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for dim in (512, 64):
        found = {r.id: r.v for r in rows.select("id", B.embedded(F.col("text"), B.embedder("hash", dim=dim)).alias("v")).collect()}
        for k, t in enumerate(texts):
            assert np.allclose(found[k], plain_vector(t or "", dim), atol=1e-12)
    assert (B.embedder("hash").name, B.embedder("hash").dim, B.embedder("hash").floor) == ("hash-512", 512, 0.20)
    with pytest.raises(KeyError, match="hash"):
        B.embedder("none")


def test_a_registered_embedder_changes_scores_alone(spark):
    B.register("vowels", lambda: B.Embedder("vowels-5", 5, 0.0, 1.0, lambda texts: np.array([[(t or "").count(v) for v in "aeiou"] for t in texts], float) / 100))
    texts = spark.createDataFrame([("Ability to build analytic dashboards",), ("Nothing",), (None,)], "text string")
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_no long, line string")
    found = {name: B.best_lines(texts, lines, B.embedder(name)) for name in ("hash", "md5", "vowels")}
    assert len({df.schema.simpleString() for df in found.values()}) == 1
    assert {name: df.where("text like 'Ability%'").first().line_no for name, df in found.items()} == {"hash": 0, "md5": 0, "vowels": 0}
    assert len({df.where("text like 'Ability%'").first().sim for df in found.values()}) == 3


@pytest.mark.parametrize("block", [4096, 2])
def test_best_lines_in_blocks_equal_brute_force(spark, block):
    rng = random.Random(3)
    words = "python dashboards bakery ovens schema data manager build design runs analytics nurse".split()
    texts = [" ".join(rng.choices(words, k=5)) for _ in range(30)]
    lines = [" ".join(rng.choices(words, k=rng.choice([2, 4, 6]))) for _ in range(9)] + [None]
    by = B.embedder("md5")
    a, kept = by.vectors(texts), [(k, x) for k, x in enumerate(lines) if x and len(x.split()) >= 4]
    sims = np.round(a @ by.vectors([x for _, x in kept]).T, 9)
    table = spark.createDataFrame([(t,) for t in texts + texts[:5]], "text string")
    numbered = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    found = {r.text: (r.line_no, r.sim) for r in B.best_lines(table, numbered, by, block=block).collect()}
    for t, row in zip(texts, sims, strict=True):
        assert found[t] == (kept[int(row.argmax())][0], row.max())
    none = B.best_lines(table.limit(1), numbered.limit(0), by).first()
    assert (none.line_no, none.sim) == (None, 0.0)
    row = table.limit(3).agg(F.collect_list("text").alias("t")).select("t", B.best_lines_in_row(F.col("t"), [x for _, x in kept], by).alias("b")).first()
    assert [x.sim for x in row.b] == [found[t][1] for t in row.t]


def test_meaning_counts_where_terms_do_not(spark):
    from brightloom.plans.scoring import TAX

    text = "Requirements\n- Building analytic dashboard for management\n- Juggling burning torches on stage"
    rows = spark.createDataFrame([("a", "s", "c", "Analyst", "", text), ("a", "s", "c", "Analyst", "", text)], "id string, source string, company string, title string, location string, description string")
    profile = M.Profile((), 4.0, "\n".join(LINES))
    plain, meant = M.scored(rows, TAX, profile).collect(), M.scored(rows, TAX, profile, B.embedder("hash")).collect()
    assert len(plain) == len(meant) == 1  # a repeated id is one posting
    assert [r.how for r in plain[0].requirement_rows] == ["term overlap", "not found"]
    first, second = meant[0].requirement_rows
    assert first.how == "semantic match" and first.evidence == LINES[0] and first.coverage > plain[0].requirement_rows[0].coverage and second.how != "semantic match"


@pytest.mark.parametrize("most_hot", [200_000, 4, 0])
def test_cosines_whatever_is_hot(spark, most_hot):
    texts = ["data pipelines data", "pipelines nurse hospital ward", None, "", "teacher school data hospital", "zebra"] * 3
    other = "data pipelines hospital"
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string")
    found = {r.id: r.cosine for r in M.similarity(rows, "id", "t", other, most_hot).collect()}
    stem = lambda w: w[:-1] if len(w) > 5 and w.endswith("s") else w
    grams = lambda t: (lambda w: Counter([*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]))([stem(w) for w in (t or "").split() if len(w) > 3])
    docs, q = [grams(t) for t in texts], grams(other)
    idf = {w: math.log((2 + len(texts)) / (1 + sum(w in d for d in [*docs, q]))) + 1 for w in {w for d in [*docs, q] for w in d}}
    weights = lambda d: {w: (1 + math.log(n)) * idf[w] for w, n in d.items()}
    norm = lambda d: math.sqrt(sum(x * x for x in d.values()))
    wq = weights(q)
    for k, d in enumerate(docs):
        w = weights(d)
        assert found[k] == pytest.approx(sum(x * wq.get(t, 0) for t, x in w.items()) / (norm(w) * norm(wq)) if w else 0.0)


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(40, 6)), 3)
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, v array<double>")
    for block in (4096, 3):
        found = X.nearest(table, table.where("vec_id % 4 = 0"), 3, block).collect()
        for q in range(0, 40, 4):
            sims = np.round(v @ v[q], 9)
            wanted = sorted((j for j in range(40) if j != q), key=lambda j: (-sims[j], j))[:3]
            assert [r.vec_id for r in sorted((r for r in found if r.q == q), key=lambda r: (-r.cosine, r.vec_id))] == wanted
    assert X.nearest(table, table.limit(0), 3).count() == 0


def test_buckets_equal_a_walk(spark):
    rng = random.Random(5)
    rows, now = [], 0
    for k in range(400):
        now += rng.choice([0, 1_000_000, 60_000_000, 1_500_000_000])
        rows.append((k, rng.choice(["hot", "hot", "hot", "b", None]), now, rng.choice([1, 1, 2, 5, 0, None])))
    rows += [(1000, "b", None, 1), (1001, "z", None, 9)]
    events = spark.createDataFrame(rows, "id int, who string, us long, cost int").withColumn("ts", F.timestamp_micros("us"))
    state, wanted = {}, {}
    for k, who, us, cost in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        cost = max(0, cost or 0)
        tokens, last = state.get(who, (4.0, None))
        if last is not None and us is not None:
            tokens = min(4.0, tokens + (us - last) * 4 / 3.6e9)
        allowed = tokens >= cost - 1e-12
        tokens -= cost if allowed else 0
        state[who] = (tokens, us if us is not None else last)
        wanted[k] = (allowed, tokens)
    found = L.rate_limited(events.repartition(7), "who", "ts", "id", 4, "cost").collect()
    assert len(found) == len(wanted)
    for r in found:
        assert r.allowed == wanted[r.id][0] and r.tokens == pytest.approx(wanted[r.id][1], abs=1e-9), r
    assert not all(r.allowed for r in found) and L.rate_limited(events.limit(0), "who", "ts", "id", 4).count() == 0


def test_functions_of_runs_stay_small():
    rng = random.Random(1)
    full = 5 * L.HOUR
    for _ in range(30):
        f, moments, now = L.Pieces.same(full), [], 0
        for _ in range(60):
            now += rng.choice([0, 7_000_000, 900_000_000])
            moments.append((now, rng.choice([1, 2, 4])))
        last = 0
        for at, cost in moments:
            f = f.then((at - last) * 5, cost * L.HOUR)
            last = at
        assert len(f.begins) < 40
        for start in [0, full, *(rng.randrange(full + 1) for _ in range(20))]:
            *_, (_, tokens) = L.walked(start, moments, 0, 5)
            assert f.at(start) == tokens


def test_buckets_of_a_stream(spark, tmp_path):
    rows = [(k, "a", 1_000_000 * k, 1) for k in range(5)] + [(9, "b", 0, 3)]
    spark.createDataFrame(rows, "id int, who string, us long, cost int").withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("id int, who string, us long, cost int, ts timestamp").parquet(str(tmp_path / "in"))
    told = stream_limits.limited_stream(events, "who", "ts", "id", 3, "cost")
    query = told.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = {r.id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    table = spark.read.parquet(str(tmp_path / "in"))
    assert found == {r.id: r.allowed for r in L.rate_limited(table, "who", "ts", "id", 3, "cost").collect()} == {0: True, 1: True, 2: True, 3: False, 4: False, 9: True}


def test_intents(spark):
    texts = ["Senior ML engineer in Bangalore or remote", "remote", None, "", "Data analyst jobs near New York, hybrid", "Analyst,data", "Nurse (graduate) based in Leeds", "head of Sales in Berlin"]
    plans = {r.k: r.plan for r in I.planned(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "text").collect()}
    p = plans[0]
    assert p.title == "ML Engineer" and "Machine Learning Engineer" in p.alt_titles and p.seniority == ["mid_senior"] and p.location == "Bangalore" and "Sales Engineer" in p.exclude_titles and p.workplace == ["remote"]
    assert (plans[1].title, plans[1].location) == ("Remote", "Remote") and plans[2].title == plans[3].title == ""
    assert plans[4].title == "Data Analyst" and plans[4].location == "New York" and plans[4].workplace == ["hybrid"] and plans[4].exclude_titles == ["Financial Analyst"] and "BI Analyst" in plans[4].alt_titles
    assert plans[5].title == "Analyst" and plans[6].seniority == ["entry"] and plans[6].location == "Leeds" and plans[7].seniority == ["director"]
    query = I.query_of(p, "2024-05-01", count=3)
    rows = [("1", "Applied Scientist II"), ("2", "ML Sales Engineer"), ("3", "Machine Learning Engineer"), ("4", "Baker")]
    postings = spark.createDataFrame([(k, "lever", "c", t, "Bangalore, India", True, None, "", "") for k, t in rows], "id string, source string, company string, title string, location string, remote boolean, posted timestamp, employment_type string, description string")
    assert {r.id: r.relevance for r in N.tagged(postings, query).collect()} == {"1": 1.0, "2": 0.0, "3": 1.0, "4": 0.0}


def test_edits_see_the_ones_before(spark):
    texts = spark.createDataFrame([(1, "Led A.\nRan B\nend"), (2, "x"), (3, None), (4, "aa aa")], "id int, text string")
    rows = [(1, 1, "replace", "Led A.", "Led C. "), (1, 2, "replace", "Led C.", "Led D"), (1, 0, "insert", "Led D", "new line"), (1, 3, "insert", "end", "last"), (2, 1, "replace", "y", "z"), (2, 2, "insert", "", "put"), (3, 1, "insert", "q", "only"), (2, 3, "odd", "x", "w"), (4, 1, "replace", "aa", "$1\\b")]
    found = {r.id: (r.text, r.missing) for r in D.apply_edits(texts, spark.createDataFrame(rows, "id int, seq int, kind string, anchor string, new string"), "id").collect()}
    assert found[1] == ("Led D\n- new line\nRan B\nend\n- last", []) and found[4] == ("$1\\b aa", [])
    assert found[2] == ("x\n- put\n", [0, 1, 2]) and found[3] == ("\n- only\n", [0])


def test_overlays_at_any_depth(spark):
    cases = [({"a": {"b": 1, "c": 2}}, {"a": {"b": None, "d": {"e": 1}}}, {"a": {"c": 2, "d": {"e": 1}}}), ({"a": 1}, {"a": {"b": 2}}, {"a": {"b": 2}}), ({"a": [1, 2]}, {"a": [3]}, {"a": [3]}), ({"é": "ü"}, None, {"é": "ü"}), (None, {"x": {"y": None}}, {"x": {}})]
    rows = [(k, json.dumps(a) if a is not None else None, json.dumps(b) if b is not None else None) for k, (a, b, _) in enumerate(cases)] + [(90, "{broken", '{"a": 1}'), (91, None, None)]
    found = {r.k: r.j for r in spark.createDataFrame(rows, "k int, a string, b string").select("k", J.merged_json(F.col("a"), F.col("b")).alias("j")).collect()}
    for k, (_, _, wanted) in enumerate(cases):
        assert json.loads(found[k]) == wanted
    assert found[90] == '{"a":1}' and found[91] is None
    keys = spark.createDataFrame([('{"b": {"y": 1, "x": [1, 2.50]}, "a": null}',), ('{"a":null,"b":{"x":[1,2.50],"y":1}}',), ('{"a":null,"b":{"x":[2.50,1],"y":1}}',), ("no",)], "t string").select(J.canonical_key(F.col("t")).alias("k"), J.canonical_json(F.col("t")).alias("j")).collect()
    assert keys[0].k == keys[1].k != keys[2].k and keys[3].k is None and keys[0].j == '{"a":null,"b":{"x":[1,2.5],"y":1}}'


def test_suites_of_nothing(spark):
    columns = "case_id int, requirement string, gold string, assessed boolean, det string, raw string, final string, verified boolean, quote string, quote_found boolean, verdict string"
    none = lambda s, d: spark.createDataFrame([], columns)
    found = {r.metric: r.value for r in U.reported(U.verifier(none, lambda df: df), spark, "").collect()}
    assert found["gold_requirements"] == 0 and found["final_accuracy"] is None and found["ai_lift"] is None and found["f1_met"] is None
    rows = [(1, "r", "met", True, "met", "met", "partial", True, "q", True, "yes"), (1, "r", "met", True, "met", "partial", "partial", True, "q", False, "no"), (2, "r", "missing", True, "missing", "met", "met", False, "", True, "no")]
    some = lambda s, d: spark.createDataFrame(rows, columns)
    found = {r.metric: r.value for r in U.reported(U.verifier(some, lambda df: df), spark, "").collect()}
    assert (found["rules_accuracy"], found["final_accuracy"], found["ai_lift"], found["final_overcredit_rate"], found["unquoted_claim_rate"], found["unsupported_quote_accepted"]) == (1.0, 0.0, -1.0, 1.0, 0.3333, 1.0)
    twice = {r.metric: r.value for r in U.reported(U.consistency(some, lambda df: df, 2), spark, "").collect()}
    assert twice == {"repeats": 2.0, "requirements": 1.0, "raw_agreement": 0.0, "final_agreement": 1.0, "verdict_flip_rate": 0.5}
    text = U.as_markdown(U.reported(U.consistency(none, lambda df: df, 3), spark, "")).first().text
    assert "| raw_agreement | n/a |" in text and text.startswith("## consistency\n\n| metric | value |")


def test_feeds_fail_by_themselves(spark, tmp_path):
    def fetch(options, feed, slug):
        if slug == "down":
            raise OSError("no answer")
        yield json.dumps({"jobs": [{"id": slug, "title": "T", "location": {"name": "Rome"}}]}) if slug != "odd" else "<html>"

    own = plugin.Plugin("test_feeds", lambda options: [("greenhouse", "acme"), ("greenhouse", "down"), ("greenhouse", "odd"), ("nobody", "x")], fetch)
    assert [(r.id, r.source, r.company) for r in plugin.all_postings(spark, "", own).collect()] == [("greenhouse-acme-acme", "greenhouse", "Acme")]
    reasons = {(r.feed, r.slug): r.reason for r in plugin.failures(spark, "", own).collect()}
    assert set(reasons) == {("greenhouse", "down"), ("greenhouse", "odd"), ("nobody", "x")} and "no answer" in reasons["greenhouse", "down"]
    rows = spark.createDataFrame([("greenhouse", "a b", '{"jobs":\n[]}'), ("workday", "x/y/z", "{}"), ("lever", "l", "[]")], "feed string, slug string, payload string")
    plugin.record(rows, str(tmp_path / "r"))
    found = plugin.scan(spark, str(tmp_path / "r")).select("feed", "slug", "payload").collect()
    assert {tuple(r) for r in found} == {("greenhouse", "a b", '{"jobs": []}'), ("workday", "x/y/z", "{}"), ("lever", "l", "[]")}
    assert plugin.scan(spark, str(tmp_path / "none")).count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = plugin.scan(spark, "", None, own).where("feed = 'greenhouse' and slug in ('acme', 'odd')")
        assert pushed.rdd.getNumPartitions() == 2 and pushed.count() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_every_feed_is_read(spark):
    from brightloom.plans.services import ITEMS

    assert set(ITEMS) == set(feeds.FEEDS)


def test_orders_of_whole_tables(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["B", "a", "", None]), rng.randrange(5)) for k in range(300)]
    table = spark.createDataFrame(rows, "id int, title string, score int").repartition(9)
    found = {r.place: r.id for r in T.placed(table, T.table_orders("title", "text"), F.desc("score")).collect()}
    wanted = sorted(rows, key=lambda r: (not r[1], (r[1] or "").lower(), -r[2], r[0]))
    assert [found[k] for k in range(1, 301)] == [r[0] for r in wanted]
    down = {r.place: r.id for r in O.ranked(table, [T.table_orders("title", "text", True), F.col("id")]).collect()}
    assert down[1] == min(r[0] for r in rows if r[1] == "B") and table.where(F.col("id") == down[300]).first().title in ("", None)


def test_pairs_to_label_equal_plain_python(spark):
    rng = random.Random(6)
    postings = [(f"p{k:03d}", rng.choice(["a", "a", "a", "b", "c"])) for k in range(90)]
    resumes = [(1, "a"), (2, "b"), (3, "z")]
    found = {tuple(r) for r in T.label_pairs(spark.createDataFrame(resumes, "resume int, occupation string"), spark.createDataFrame(postings, "id string, occupation string"), 9, "s").collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    wanted = set()
    for resume, own in resumes:
        wanted |= {(resume, i, True) for i in sorted(i for i, o in postings if o == own)[:3]}
        pool = [i for kind in {o for _, o in postings} - {own} for i in sorted((i for i, o in postings if o == kind), key=lambda i: (md5("s" + i), i))[:6]]
        wanted |= {(resume, i, False) for i in sorted(pool, key=lambda i: (md5(f"s{resume}{i}"), i))[:6]}
    assert found == wanted


def test_large_feeds_are_read_in_parts(spark, tmp_path, monkeypatch):
    """A slug's files are dealt over tasks, and batches are bounded by letters."""
    payloads = [json.dumps([{"id": str(k), "text": "x" * 50}]) for k in range(40)]
    rows = spark.createDataFrame([("lever", "acme", p) for p in payloads], "feed string, slug string, payload string").repartition(4)
    monkeypatch.setattr(plugin, "FILE_PAYLOADS", 3)
    plugin.record(rows, str(tmp_path / "r"))
    monkeypatch.setattr(plugin, "PART_BYTES", 1000)
    monkeypatch.setattr(plugin, "MOST_LETTERS", 200)
    reader = plugin.SlugReader(plugin.RECORDED, {"path": str(tmp_path / "r")})
    parts = reader.partitions()
    batches = [b for p in parts for b in reader.read(p)]
    assert len(parts) >= 4 and all(b.num_rows <= 3 for b in batches)
    assert sorted(x for b in batches for x in b.column("payload").to_pylist()) == sorted(payloads)
    monkeypatch.undo()
    assert plugin.scan(spark, str(tmp_path / "r")).count() == 40


def test_payloads_do_not_grow_with_the_postings(spark, monkeypatch):
    from brightloom.plans import services

    monkeypatch.setattr(services, "PAGE", 1)
    found = services.payloads(spark, "/root/testdata/sf0.001").where("feed = 'lever'").select(F.size(F.from_json("payload", "array<struct<id: string>>")).alias("n"))
    assert found.count() > 16 and found.agg(F.max("n")).first()[0] < 10
