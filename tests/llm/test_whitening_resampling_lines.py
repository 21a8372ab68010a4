"""Whitening, importance resampling and line deduplication against brute force; nulls, empties, repeats, ties, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.llm import line_dedup, resampling, whitening
from brightloom.llm.line_dedup import Filters, keys_of, line_report, without_repeated_lines
from brightloom.llm.resampling import counts, resampled
from brightloom.llm.whitening import merged, summary_of, whitening_report

SCHEMA = "doc_id long, text string, bucket string, _lines string, n_lines string, key string"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "clash", "clash", "clash", "clash") for k, t in rows], SCHEMA)


def test_merging_is_lossless():
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (300, 12)) + 1_000_000
    parts = [summary_of(x[a:b]) for a, b in ((0, 1), (1, 4), (4, 150), (150, 300))]
    found = merged(merged(parts[0], parts[1]), merged(parts[2], parts[3]))
    wanted = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert found.n == 300 and found.total == x.sum(axis=0).tolist()
    assert np.allclose(found.factors, wanted, rtol=1e-12)
    assert np.allclose((found.directions.T * found.factors**2) @ found.directions, (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)), rtol=1e-10, atol=1e-7)


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 1, 2) for k, v in rows], "vec_id long, embedding array<float>, component int, x string")


def test_whitening_equals_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "CHUNK", 16)
    rng = np.random.default_rng(2)
    mixing = rng.normal(size=(20, 20))
    data = (rng.normal(size=(150, 20)) @ mixing).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(data)]
    rows += [(1000 + k, data[3].tolist()) for k in range(40)] + [(None, data[5].tolist())] * 2
    rows += [(2000, None), (2001, [None] * 20), (2002, [float("nan")] * 20), (2003, [1.0] * 19 + [float("inf")]), (2004, [1.0] * 7), (2005, [])]
    found = whitening_report(vectors(spark, rows).repartition(30)).collect()
    x = np.floor(64 * data.astype(float)).astype(np.int64) + 1_000_000
    distinct = np.unique(x, axis=0)
    n, total = len(distinct), distinct.sum(axis=0)
    centred = distinct - total / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    told = defaultdict(dict)
    for r in found:
        told[r.vec_id][r.component] = r
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12
    assert len(found) == 16 * 192 and set(told) == {None, *range(150), *range(1000, 1040)}
    signs = [np.sign(told[0][c].whitened) * np.sign((x[0] - total / n) @ directions[:, c - 1]) for c in range(1, 17)]
    for k in (*range(150), *range(1000, 1040)):
        own = x[3] if k >= 1000 else x[k]
        assert told[k][1].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(own, total, strict=True))
        wanted = (own - total / n) @ directions[:, :16] / np.sqrt(values[:16]) * signs
        assert np.allclose([told[k][c].whitened for c in range(1, 17)], wanted, atol=1e-8)


def test_whitening_of_little(spark):
    assert whitening_report(vectors(spark, [(1, None), (2, [None])])).count() == 0
    one = whitening_report(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 0, None, None)] * 4
    flat = whitening_report(vectors(spark, [(1, [0.0, 1.0]), (2, [0.0, 3.0]), (3, [0.0, 3.0])])).collect()
    assert {(r.vec_id, r.component): None if r.whitened is None else round(r.whitened, 9) for r in flat} == {(1, 1): -1.0, (2, 1): 1.0, (3, 1): 1.0, (1, 2): None, (2, 2): None, (3, 2): None}
    assert max(r.identity_error for r in flat) < 1e-9
    huge = whitening_report(vectors(spark, [(1, [3e38]), (2, [-3e38])])).collect()
    assert {r.deviation for r in huge} == {None} and {round(abs(r.whitened), 9) for r in huge} == {1.0}  # beyond a long


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), Counter(" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1))


def test_counts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BYTES", 50)
    texts = [None, "", "!?", "A b a-B", "Élan élan ÉLAN\x00x", "日本 語1", "w " * 5000, "a b"]
    for longest in (1, 3):
        found = {r.key: r for r in counts(documents(spark, enumerate(texts)), "doc_id", longest, 50).collect()}
        for k, t in enumerate(texts):
            n, grams = features(t, longest)
            wanted = Counter()
            for g, times in grams.items():
                wanted[zlib.crc32(g.encode()) % 50] += times
            assert (found[k].n_words, found[k].n_features) == (n, sum(grams.values()))
            assert dict(zip(found[k].buckets, found[k].times, strict=True)) == dict(wanted)


def test_resampling_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choice(words[: 300 if k % 3 else 40]) for _ in range(rng.choice([0, 5, 19, 20, 80])))) for k in range(120)]
    rows += [(None, rows[4][1] + " Σ" * 20), (7, rows[7][1]), (200, None), (201, "")]
    target = [" ".join(rng.choice(words[:40]) for _ in range(30)) for _ in range(5)] + [None]
    found = resampled(documents(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), percent=25).collect()
    s, t = Counter(), Counter()
    for counter, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for g, times in features(text, 1)[1].items():
                counter[zlib.crc32(g.encode()) % 10_000] += times
    big, small = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big + 10_000) / ((s[b] + 1) * (small + 10_000)))) for b in {*s, *t}}
    wanted, able = [], []
    for k, text in rows:
        n, grams = features(text, 1)
        weight = sum(gain[zlib.crc32(g.encode()) % 10_000] * times for g, times in grams.items())
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        wanted.append((k, n, weight, score))
        if n >= 20:
            able.append((-score, k is not None, k or 0, k))
    assert sorted(map(str, wanted)) == sorted(str((r.doc_id, r.n_features, r.weight, r.score)) for r in found)
    drawn = [a[3] for a in sorted(able)][: 25 * len(able) // 100]
    assert drawn and [r.doc_id for r in sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, len(drawn) + 1))
    empty = documents(spark, rows).limit(0)
    assert resampled(empty, empty).count() == 0 and resampled(documents(spark, rows), empty).where("rank is not null").count() == 10 * len(able) // 100


def line_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def without_lines(rows, least_length=40, least_docs=5):
    at = defaultdict(set)
    order = lambda k: (k is not None, k or 0)
    for k, text in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= least_length:
                at[line_key(line)].add(k)
    told = []
    for k, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(at.get(line_key(x), ())) < least_docs or max(at[line_key(x)], key=order) == k]
        told.append((k, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return told


def lines_case():
    rng = random.Random(6)
    long = [f"Line number {k} stands here and is long enough" for k in range(30)] + ["é" * 39, "é" * 40, "É" * 40, "x" * 39, " " * 60]
    rows = [(k, "\n".join(rng.choice([line, line.upper(), f" \t{line}\r", f" {line}"]) for line in rng.choices(long, k=rng.choice([1, 3, 9])))) for k in range(60)]
    rows += [(60 + k, f"{'Everywhere and always the very same line of text'}\n{k}\n") for k in range(50)]
    return rows + [(None, rows[3][1]), (None, rows[4][1]), (5, rows[6][1]), (7, rows[7][1]), (300, None), (301, ""), (302, "\n\n"), (303, "a" * 100_000)]


@pytest.mark.parametrize("most", [line_dedup.MOST_BROADCAST, 0])
def test_lines_equal_brute_force(spark, most):
    rows = lines_case()
    docs = documents(spark, rows).repartition(12)
    found = without_repeated_lines(docs, most_broadcast=most, hot=10)
    told = found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("h")).collect()
    assert sorted(map(str, without_lines(rows))) == sorted(str(tuple(r)) for r in told)
    assert {"bucket", "_lines", "key"} <= set(found.columns) and sum(r.n_dropped for r in told) > 90
    assert without_repeated_lines(docs.limit(0), most_broadcast=most).count() == 0


def test_full_filters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FAN", 2)
    rows = lines_case()
    docs = documents(spark, rows).repartition(9)
    assert sorted(map(str, without_lines(rows))) == sorted(str(tuple(r)) for r in line_report(docs).collect())
    full = without_repeated_lines(docs, most_bits=8)
    assert sorted((str(k), n) for k, _, n, _ in without_lines(rows)) == sorted((str(r.doc_id), r.n_dropped) for r in full.collect())


def test_filters_miss_nothing():
    rng = np.random.default_rng(3)
    own = [rng.integers(0, 1 << 63, 500).astype(np.uint64) for _ in range(3)]
    shared = own[0][:50]
    parts = []
    for hashes in (own[0], np.concatenate([own[1], shared]), own[2]):
        parts.append(Filters(1 << 14))
        parts[-1].add(hashes)
    parts[1].merge(parts[2])
    parts[0].merge(parts[1])
    seen = line_dedup.holds(parts[0].twice, line_dedup.probes(np.concatenate(own), 1 << 14))
    assert seen[:50].all() and seen.mean() < 0.2
    assert keys_of("ÀB\n c \n".encode(), 1) == ["ÀB".encode().replace(b"B", b"b"), b"c", None]
