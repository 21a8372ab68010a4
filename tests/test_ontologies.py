"""Ontology readers, the automaton, SimHash, near classes and greedy choices against plain Python."""

import random
import time
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from brightloom.operators import near as N
from brightloom.operators import ontology as O
from brightloom.operators import skills as S

KNOWN = [("PostgreSQL", "Data", "postgresql", None), ("PostgreSQL", "Data", "postgres", None), ("MySQL", "Data", "mysql", None), ("Excel", "Office", "excel", None)]
TABLE = "skill string, category string, alias string, context array<string>"


def test_concepts_of_a_file(spark, tmp_path):
    (tmp_path / "skills.csv").write_text(
        'conceptUri,preferredLabel,altLabels\nu1,PostgreSQL,"postgre sql\npostgres database"\nu2,MySQL,my sql|a b c d e f\nu3,basket weaving,weaving baskets\nu4,,\nu5,POSTGRES,"say ""postgres"" | ¡no!"\n', encoding="utf-8"
    )
    (tmp_path / "relations.csv").write_text("originalSkillUri,relatedSkillUri,relationType\nu1,u2,optional\nu2,u1,\nu1,u5,related\nu1,u3,optional\nu2,u5,essential\n", encoding="utf-8")
    known = spark.createDataFrame(KNOWN, TABLE)
    concepts = O.read_concepts(spark, str(tmp_path / "skills.csv"))
    assert {tuple(r) for r in O.linked(concepts, known).collect()} == {("u1", "PostgreSQL"), ("u2", "MySQL"), ("u5", "PostgreSQL")}
    found = O.new_aliases(concepts, known)
    assert {tuple(r) for r in found.collect()} == {("PostgreSQL", "postgre sql"), ("PostgreSQL", "postgres database"), ("MySQL", "my sql")}
    related = O.new_relations(O.read_relations(spark, str(tmp_path / "relations.csv")), concepts, known)
    assert [tuple(r) for r in related.collect()] == [("MySQL", "PostgreSQL")]
    taxonomy = S.Taxonomy.load(O.extended(known, found))
    rows = spark.createDataFrame([(1, "We use my SQL, no postgres database."), (2, None), (3, "")], "id int, description string")
    assert {tuple(r) for r in S.mentions(rows, taxonomy).collect()} == {(1, "MySQL", False), (1, "PostgreSQL", True)}
    empty = concepts.limit(0)
    assert O.new_aliases(empty, known).count() == 0 and O.new_aliases(concepts, known.limit(0)).count() == 0


def test_technologies_of_a_file(spark, tmp_path):
    (tmp_path / "tech.txt").write_text('O*NET-SOC Code\tExample\tCommodity Code\n1\tMicrosoft Excel\t2\n1\tExcel\t2\n1\tOracle/MySQL "pro"\t2\n1\tmysql/excel suite\t2\n1\t\t2\n1\tAcme CAD\t2\n', encoding="utf-8")
    found = O.new_technologies(O.read_technologies(spark, str(tmp_path / "tech.txt")), spark.createDataFrame(KNOWN, TABLE))
    assert {tuple(r) for r in found.collect()} == {("Excel", "microsoft excel"), ("MySQL", "mysql/excel suite")}


def test_many_aliases_are_planned_at_once(spark):
    taxonomy = S.Taxonomy.of([(f"Skill {k}", "X", f"alias{k} of many", None) for k in range(50_000)])
    rows = spark.createDataFrame([(1, "an alias7 of many; no alias49999 of many\nalias8 of"), (2, "nothing")], "id int, description string")
    began = time.perf_counter()
    found = S.mentions(rows, taxonomy)
    found._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - began < 5
    assert {tuple(r) for r in found.collect()} == {(1, "Skill 7", False), (1, "Skill 49999", True)}


def test_large_taxonomies_are_refused(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_LETTERS", 20)
    with pytest.raises(ValueError, match="mentions_joined"):
        S.Taxonomy.load(spark.createDataFrame(KNOWN, TABLE))


def test_overlapping_and_equal_aliases(spark):
    rows = [("A", "X", "data", None), ("B", "X", "data base", None), ("C", "X", "base data", None), ("D", "X", "data", ["sql"]), ("E", "X", "", None)]
    texts = spark.createDataFrame([(1, "Data base data."), (2, "sql data"), (3, "data. base"), (4, "database")], "id int, description string")
    found = {(r.id, r.skill) for r in S.mentions(texts, S.Taxonomy.of(rows)).collect()}
    assert found == {(1, "A"), (1, "B"), (1, "C"), (2, "A"), (2, "D"), (3, "A")}


def plain_simhash(text):
    import re

    words = re.findall("[a-z0-9]+", (text or "").lower())
    hashes = [int.from_bytes(md5(" ".join(words[k : k + 3]).encode()).digest()[:8], "big") for k in range(len(words) - 2)]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
    return bits - (1 << 64) if bits >> 63 else bits


def test_simhash_equals_plain_python(spark):
    texts = [None, "", "a b", "a b c", "Straße – 3 apples; A.B.C", "x y z " * 300] + [" ".join(random.Random(k).choices("abcdefgh", k=40)) for k in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert {r.id: r.simhash for r in N.simhash(rows, "id", "text").collect()} == {k: plain_simhash(t) for k, t in enumerate(texts)}


def hashes_of(rng, n):
    """Chains, copies and stars of hashes, in two blocks and a null one, some of hash 0."""
    rows, base = [], [rng.getrandbits(63) for _ in range(4)]
    for k in range(n):
        h = rng.choice(base)
        for _ in range(rng.choice([0, 1, 2, 4])):
            h ^= 1 << rng.randrange(63)
        base += [h] if rng.random() < 0.2 else []
        rows.append((rng.choice(["a", "b", None]), k, 0 if rng.random() < 0.05 else h, rng.randrange(5)))
    return rows


@pytest.mark.parametrize("bucket", [1024, 3])
def test_greedy_choice_equals_one_by_one(spark, bucket):
    rows = hashes_of(random.Random(bucket), 150)
    leaders, wanted = {}, {}
    for block, k, h, turn in sorted(rows, key=lambda r: (r[3], r[1])):
        own = leaders.setdefault(block, [])
        met = next((i for i, x in own if h and x and (h ^ x).bit_count() <= 3), None)
        wanted[k] = k if met is None else met
        if met is None:
            own.append((k, h))
    table = spark.createDataFrame(rows, "block string, id long, simhash long, turn int")
    found = N.greedy_classes(table, ["block"], [F.col("turn")], bucket=bucket)
    assert {r.id: r.leader_id for r in found.collect()} == wanted
    assert N.greedy_classes(table.limit(0), ["block"], [F.col("turn")]).count() == 0


def test_a_chain_is_two_groups(spark):
    table = spark.createDataFrame([("x", 1, 0b111 << 8), ("x", 2, 0b111111 << 8), ("x", 3, 0b111111111 << 8)], "block string, id long, simhash long")
    assert {r.id: r.leader_id for r in N.greedy_classes(table, ["block"], [F.col("id")]).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.class_id for r in N.near_classes(table, ["block"]).collect()} == {1}


@pytest.mark.parametrize("bucket", [1024, 3])
def test_classes_equal_brute_force(spark, bucket):
    rows = hashes_of(random.Random(9), 150)
    linked = {k: {j for b, j, x, _ in rows if j != k and a == b and h and x and (h ^ x).bit_count() <= 3} for a, k, h, _ in rows}
    top = {k: k for k in linked}
    for _ in rows:
        top = {k: min([top[k], *(top[j] for j in linked[k])]) for k in top}
    table = spark.createDataFrame([r[:3] for r in rows], "block string, id long, simhash long")
    found = N.near_classes(table, ["block"], bucket=bucket).collect()
    assert {r.id: (r.class_id, r.n_links) for r in found} == {k: (top[k], len(linked[k])) for k in linked}
