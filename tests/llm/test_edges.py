"""Edge cases of the corpus operators: several goes, very long texts, null ids, repeats, empty tables, more languages, held-out quality of the given tables."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brightloom.llm import decontamination, language_id, url_filters
from brightloom.llm.language_id import keep_known_language, language_report
from brightloom.llm.near_duplicates import one_of_each
from brightloom.llm.queries import URL_RULES
from brightloom.llm.toxicity import toxicity_report
from brightloom.llm.words import hashes_of, word_hashes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, _match string, _toxicity string"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", "clash", "clash") for k, t in rows], SCHEMA)


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_several_goes_find_the_same(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"term{k}" for k in range(900)]
    items = [(k, prose(rng, words, rng.choice([5, 20, 60]))) for k in range(25)] + [(None, prose(rng, words, 20)), (7, prose(rng, words, 30))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, prose(rng, words, 50) + " " + items[k % 27][1] + " " + prose(rng, words, 30) + (" " + items[(k * 5 + 1) % 27][1] if k % 3 == 0 else "")) for k in range(40)]
    docs = documents(spark, rows + [(100, None), (101, ""), (None, prose(rng, words, 99)), (None, rows[0][1]), (1, rows[1][1]), (200, prose(rng, words, 80))])
    told = lambda: sorted(map(str, decontamination.contamination_report(docs, benchmark).collect()))
    left = lambda: sorted(str(r.doc_id) for r in decontamination.keep_uncontaminated(docs, benchmark).collect())
    once, kept = told(), left()
    assert len(once) >= 50 and kept == ["100", "101", "200", "None"]
    monkeypatch.setattr(decontamination, "A_GO", 12)
    assert told() == once and left() == kept
    assert decontamination.contamination_report(docs, benchmark.limit(0)).count() == 0 and decontamination.contamination_report(docs.limit(0), benchmark).count() == 0
    assert decontamination.contamination_report(docs, benchmark.limit(0)).columns == decontamination.contamination_report(docs, benchmark).columns


def test_items_in_texts_beyond_a_chunk(spark):
    rng = random.Random(4)
    words = [f"term{k}" for k in range(2000)]
    item = prose(rng, words, 30)
    n = decontamination.CHUNK
    rows = [(k, f"{prose(rng, words, at)} {item} {prose(rng, words, 50)}") for k, at in enumerate([0, n - 31, n - 15, n - 1, n, 2 * n - 10])] + [(9, prose(rng, words, 2 * n))]
    found = decontamination.contamination_report(documents(spark, rows), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.kind) for r in found} == {(k, 5, "copy") for k in range(6)}


def holds(words, item):
    """Brute force as the contract of a match says it; stretches that lack too many of the passage's words are passed over."""
    whole = word_hashes(item).tolist()
    most = next((n for n in decontamination.PASSAGES if len(whole) < n * 3 // 2), decontamination.PASSAGES[-1])
    last = max(0, len(whole) - most)
    answer = set(decontamination.answer_words(item).tolist())
    there = set(words)
    for at in {*range(0, last, most // 2), last}:
        part = whole[at : at + most]
        if sum(w in there for w in part) < decontamination.WEAK * len(part):
            continue
        masks, reach = defaultdict(int), len(part) + 2 * decontamination.SLACK
        for k, w in enumerate(part):
            masks[w] |= 1 << k
        for start in range(max(1, len(words) - reach + 1)):
            window = words[start : start + reach]
            if sum(w in masks for w in window) < decontamination.WEAK * len(part):
                continue
            common = decontamination.common_length(masks, len(part), window) / len(part)
            near = answer.intersection(words[max(0, start - len(whole)) : start + reach + len(whole)])
            if common >= decontamination.STRONG or (common >= decontamination.WEAK and len(near) >= decontamination.ANSWER * len(answer)):
                return True
    return False


def test_recall_on_the_given_benchmark(spark):
    """All documents against all items by brute force: at least nine tenths are found, and nothing else."""
    docs, benchmark = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontamination.contamination_report(docs, benchmark).collect()}
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    hashed = [(k, w.tolist()) for (k, _), w in zip(texts, hashes_of([t for _, t in texts]), strict=True)]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    true = {(k, i) for k, w in hashed for i, item in items if holds(w, item)}
    assert true and found <= true and len(found) >= 0.9 * len(true)


def test_urls_without_rules_ids_or_hosts(spark):
    pages = spark.createDataFrame([(1, "http://A.example.NET/en/x?y"), (None, "http://x.net"), (1, "http://A.example.NET/en/x?y"), (2, None), (3, "no scheme"), (4, "http://"), (5, "ftp://b.org/fr/")], "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "rule string, action string")
    told = sorted((str(r.page_id), r.host, r.path, r["rule"], r.verdict) for r in url_filters.judge(pages, rules).collect())
    assert told == sorted([("1", "a.example.net", "/en/x", "example.net/en/", "allow")] * 2 + [("None", "x.net", "", None, "allow"), ("2", "", "", None, "allow"), ("3", "", "", None, "allow"), ("4", "", "", None, "allow"), ("5", "b.org", "/fr/", "org/fr/", "allow")])
    assert {r["rule"] for r in url_filters.judge(pages, rules.limit(0)).collect()} == {None} and url_filters.judge(pages.limit(0), rules).count() == 0


def test_one_of_repeated_rows_with_null_ids(spark):
    text = "a b c d e f g h i j k l m n o p"
    rows = [(None, text), (None, text), (3, text), (None, None), (None, None), (None, ""), (5, "something else that stands alone here"), (5, "something else that stands alone here")]
    found = sorted((str(r.doc_id), str(r.text)) for r in one_of_each(documents(spark, rows)).collect())
    assert found == sorted([("3", text), ("None", "None"), ("None", "None"), ("None", ""), ("5", rows[6][1])])


def test_known_languages_of_repeats_and_nulls(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    more = docs.where("lang is not null").limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    odd = spark.createDataFrame([(None, None, None), (None, "123 ...", None), (None, "", "en")], docs.schema)
    both = docs.unionByName(more).unionByName(more).unionByName(odd)
    kept = keep_known_language(both)
    assert kept.where("text is null or text = '' or text = '123 ...'").count() == 0
    assert kept.where("doc_id is null").count() in (0, 2, 4, 6) and keep_known_language(docs.limit(0)).count() == 0


def test_more_languages_than_an_exhaustive_code(spark):
    """Beyond EXHAUSTIVE languages codewords are drawn; made-up languages of their own letters are told apart all the same."""
    rng = random.Random(7)
    n = language_id.EXHAUSTIVE + 5
    letters = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 7)) for _ in range(n)]
    word = lambda k: "".join(rng.choice(letters[k]) for _ in range(rng.randrange(3, 8)))
    rows = [(k, " ".join(word(k % n) for _ in range(60)), f"l{k % n:02d}") for k in range(60 * n)]
    found = {r.doc_id: r for r in language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(found[k].lang_pred, lang) for k, _, lang in rows if found[k].held_out]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.97 * len(held)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_quality(spark, sf):
    """What README says of language and toxicity, on rows that nothing was learned from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    told = language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right, n = told.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 100 and right >= 0.98 * n
    scores = toxicity_report(docs, labels).join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").where("held_out").collect()
    bad, good = [r.score for r in scores if r.toxic], [r.score for r in scores if not r.toxic]
    auc = sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good))
    assert len(bad) >= 5 and auc >= 0.9 and sum(r.predicted for r in scores if not r.toxic) <= 0.02 * len(good)
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in scores)
