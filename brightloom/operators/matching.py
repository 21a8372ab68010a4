"""Scoring of postings against a profile: skills, requirement lines, role, years, similarity of terms, gates and the report."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import discard, distinct_texts, durable, spread, text_key
from ..functions import values as V
from ..functions.text import grams, let, terms
from . import embedding as B
from . import gates as G
from . import requirements as Q
from . import skills as S
from .calibration import Calibration, usable
from .lines import with_lines
from .records import only_once

MOST_HOT = 200_000  #: terms whose weights go to all tasks, some 20 MB
TOP_WORDS = 12
MINIMUM = {"keyword_skills": 3, "keyword_text": 200, "text": 80}


@dataclass(frozen=True)
class Profile:
    """One person: skills, years and the resume's text, with what skills imply and what they are related to."""

    skills: tuple[str, ...]
    years: float
    text: str
    education: str | None = None
    implied: tuple[tuple[str, str], ...] = ()  # (skill, owned skill that implies it)
    related: tuple[tuple[str, str], ...] = ()  # (skill, least owned skill related to it)
    eligibility: G.Eligibility = field(default_factory=G.Eligibility)

    @property
    def head(self) -> str:
        return self.text[:400]


def profile_of(spark: SparkSession, text: str, years: float, taxonomy: S.Taxonomy, edges: DataFrame, related: DataFrame, eligibility: G.Eligibility | None = None) -> Profile:
    """The profile of one resume: skills and degree are read from it, and what they imply from the ontology (src, dst) and relations (a, b)."""
    row = spark.range(1).select(S.wanted_of(S.hits_in(S.words_of(F.lit(text)), taxonomy)).alias("s"), Q.education_level(F.lit(text)).alias("e")).first()
    owned = spark.createDataFrame([(s,) for s in row["s"]], "skill string")
    by = closure(edges).join(owned.withColumnRenamed("skill", "src"), "src").groupBy("dst").agg(F.min("src").alias("via")).join(owned.withColumnRenamed("skill", "dst"), "dst", "left_anti")
    near = related.join(owned.withColumnRenamed("skill", "b"), "b").groupBy("a").agg(F.min("b").alias("via"))
    pairs = lambda df: tuple(tuple(r) for r in df.collect())  # noqa: E731 (no more rows than skills within reach of one person's)
    return Profile(tuple(row["s"]), years, text, row["e"], pairs(by.select("dst", "via")), pairs(near.select("a", "via")), eligibility or G.Eligibility())


def closure(edges: DataFrame) -> DataFrame:
    """src, dst: what is implied, directly or through others, by a small ontology; ends when a round adds nothing."""
    known = durable(edges.select("src", "dst").distinct())
    n = known.count()
    while True:
        step = known.alias("k").join(known.alias("e"), F.col("k.dst") == F.col("e.src")).select("k.src", "e.dst")
        known, old = durable(known.union(step).where("src <> dst").distinct()), known  # each round doubles the length of chains
        discard(old)
        if (m := known.count()) == n:
            return known
        n = m


def related_pairs(groups: DataFrame) -> DataFrame:
    """a, b: skills that share a group (group, skill), both ways. Groups are of a taxonomy: repeated rows are one, nulls go."""
    once = groups.where("group is not null and skill is not null").select("group", "skill").distinct()
    a, b = once.select("group", F.col("skill").alias("a")), once.select("group", F.col("skill").alias("b"))
    return a.join(b, "group").where("a <> b").select("a", "b").distinct()


def credits(required: DataFrame, owned: DataFrame, implied: DataFrame, related: DataFrame, partial: float) -> DataFrame:
    """`required` (with skill) and credit, how (exact, implied, related, missing) and via (the first such skill by name)."""
    by_closure = implied.join(owned.withColumnRenamed("skill", "src"), "src").groupBy(F.col("dst").alias("skill")).agg(F.min("src").alias("_implied"))
    near = related.join(owned.withColumnRenamed("skill", "b"), "b").groupBy(F.col("a").alias("skill")).agg(F.min("b").alias("_related"))
    rows = required.join(owned.withColumn("_owned", F.lit(True)), "skill", "left").join(by_closure, "skill", "left").join(near, "skill", "left")
    how = F.when(F.col("_owned"), "exact").when(F.col("_implied").isNotNull(), "implied").when(F.col("_related").isNotNull(), "related").otherwise("missing")
    rows = rows.withColumn("how", how)
    credit = F.when(F.col("how").isin("exact", "implied"), 1.0).when(F.col("how") == "related", partial).otherwise(0.0)
    via = F.when(F.col("how") == "implied", F.col("_implied")).when(F.col("how") == "related", F.col("_related"))
    return rows.withColumns({"credit": credit, "via": via}).drop("_owned", "_implied", "_related")


def credit_of(skill: Column, profile: Profile) -> Column:
    """struct<credit, how, via> of one required skill."""
    table = lambda pairs: F.create_map(*(F.lit(x) for pair in pairs for x in pair)).cast("map<string, string>") if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    implied, related = F.try_element_at(table(profile.implied), skill), F.try_element_at(table(profile.related), skill)
    exact = skill.isin(*profile.skills)
    how = F.when(exact, "exact").when(implied.isNotNull(), "implied").when(related.isNotNull(), "related").otherwise("missing")
    credit = F.when(exact | implied.isNotNull(), 1.0).when(related.isNotNull(), V.RELATED_CREDIT).otherwise(0.0)
    return F.struct(credit.alias("credit"), how.alias("how"), F.when(~exact, F.coalesce(implied, related)).alias("via"))


def experience_score(required: Column, years: float) -> Column:
    scaled = F.least(F.lit(1.0), F.lit(years) / required) if years > 0 else F.lit(0.4)
    return F.when(required.isNull(), 0.85).when(required == 0, 1.0).otherwise(scaled)


def title_fit(title: Column, text: str, head: str) -> Column:
    """0 to 1: how far a posting's role words begin words of the resume; its head and the whole phrase count extra."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[a-z+#.]+"), F.lit(0)), lambda t: ~t.isin(*V.TITLE_NOISE))
    starts = lambda s: F.lit(sorted({s[m.start() : m.start() + 60] for m in re.finditer(r"\b", s)})).cast("array<string>")
    low, top = starts(text.lower()), starts(head.lower())
    begins = lambda some, t: F.exists(some, lambda s: F.startswith(s, t))
    weight = lambda t: F.when(t.isin(*V.WEAK_TITLE), 0.4).otherwise(1.0)
    total = lambda some: F.aggregate(some, F.lit(0.0), lambda s, t: s + weight(t))

    def fit(w: Column) -> Column:
        distinct = F.array_distinct(w)
        share = total(F.filter(distinct, lambda t: begins(low, t))) / total(distinct)
        phrase = F.when(F.contains(F.lit(text.lower()), F.array_join(w, " ")), 0.3).otherwise(0.0)
        heading = F.when(F.exists(distinct, lambda t: ~t.isin(*V.WEAK_TITLE) & begins(top, t)), 0.1).otherwise(0.0)
        return F.when(F.size(w) == 0, 0.5).otherwise(F.least(F.lit(1.0), share * 0.7 + phrase + heading))

    return let(words, fit)


def repeated_words(description: Column) -> Column:
    """Of the TOP_WORDS most frequent words that carry meaning (ties: the first met) those that occur at least twice."""
    words = F.filter(F.regexp_extract_all(F.lower(description), F.lit(r"[a-z][a-z+#.\-]{2,}"), F.lit(0)), lambda w: ~w.isin(*V.STOP) & (F.length(w) > 3))
    counted = lambda some: F.transform(F.array_distinct(some), lambda w, i: F.struct((-F.size(F.filter(some, lambda x: x == w))).alias("n"), i.alias("i"), w.alias("w")))
    return F.transform(F.filter(F.slice(F.array_sort(let(words, counted)), 1, TOP_WORDS), lambda c: c["n"] <= -2), lambda c: c["w"])


def total_score(components: dict[str, Column], penalty: Column, capped: Column, calibration: Calibration | None = None) -> Column:
    """0 to 100, rounded half to even; noise in the ninth place doesn't decide a half. A usable calibration takes the place of the weights set by hand."""
    fitted = usable(calibration)
    total = (fitted.apply(components) if fitted else sum((V.WEIGHTS[k] * c for k, c in components.items()), F.lit(0.0))) - penalty
    total = F.when(capped, F.least(total, F.lit(0.45))).otherwise(total)
    return F.bround(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)) * 100, 9)).cast("int")


def weighed(terms_: Column, hot: dict[str, tuple[float, float]]) -> Column:
    """struct<dot, norm2, cold> beside an array of terms: sums over its words and pairs that are in `hot` (idf, weight in the other text), and the rest with their counts."""

    @F.arrow_udf("struct<dot: double, norm2: double, cold: array<struct<term: string, tf: int>>>")
    def told(rows: pa.Array) -> pa.Array:
        found = []
        for row in rows.to_pylist():
            own = row or []
            dot = norm2 = 0.0
            cold = []
            for term, n in Counter([*own, *(f"{a} {b}" for a, b in zip(own, own[1:], strict=False))]).items():
                known = hot.get(term)
                if known is None:
                    cold.append({"term": term, "tf": n})
                else:
                    w = (1 + math.log(n)) * known[0]
                    norm2 += w * w
                    dot += w * known[1]
            found.append({"dot": dot, "norm2": norm2, "cold": cold})
        cold = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
        return pa.array(found, pa.struct([("dot", pa.float64()), ("norm2", pa.float64()), ("cold", cold)]))

    return told(terms_)


def with_cosine(rows: DataFrame, terms_column: str, other: str, most_hot: int = MOST_HOT, copies: str | None = None) -> DataFrame:
    """`rows` (from the shared folder, with an array of terms) and cosine: of TF-IDF vectors of each row's terms and pairs against those of the text `other`, which counts as one more document.

    A row counts as one document, or as many as the column `copies` says.

    Documents are counted for each term by an aggregate with partial results. The most frequent `most_hot` terms go to all
    tasks, and what a row has of them is summed within it; only terms beyond are joined by equality, none of which is a
    large part of all, as at most `most_hot` can be. With fewer terms than that, nothing but the counts is shuffled.
    """
    spark = rows.sparkSession
    many = F.col(copies) if copies else F.lit(1)
    n = rows.agg(F.coalesce(F.sum(many), F.lit(0))).first()[0]
    theirs = spark.createDataFrame([(other,)], "t string").select(F.explode(grams(terms(F.col("t"), V.STOP))).alias("term")).groupBy("term").agg(F.count("*").alias("tf_q"))
    df = rows.select(many.alias("_many"), F.explode(F.array_distinct(grams(F.col(terms_column)))).alias("term")).groupBy("term").agg(F.sum("_many").alias("df")).join(F.broadcast(theirs), "term", "full")
    idf = F.ln((2 + F.lit(n)) / (1 + F.coalesce("df", F.lit(0)) + F.col("tf_q").isNotNull().cast("int"))) + 1
    told = durable(df.select("term", F.coalesce("df", F.lit(0)).alias("df"), idf.alias("idf"), F.coalesce(F.when(F.col("tf_q").isNotNull(), (1 + F.ln("tf_q")) * idf), F.lit(0.0)).alias("wq")))
    norm = told.agg(F.sqrt(F.sum(F.col("wq") * F.col("wq")))).first()[0] or 0.0
    bars = [n >> k for k in range(n.bit_length() + 1)]  # from all rows down to 0
    above = told.agg(*(F.count_if(F.col("df") > b) for b in bars)).first()
    bar = min(b for b, count in zip(bars, above, strict=True) if count <= most_hot)
    hot = {r.term: (r.idf, r.wq) for r in told.where(F.col("df") > bar).select("term", "idf", "wq").toLocalIterator()}  # at most `most_hot`
    summed = rows.withColumn("_w", weighed(F.col(terms_column), hot))
    cosine = lambda dot, norm2: F.coalesce(F.try_divide(dot, F.sqrt(norm2) * F.lit(norm)), F.lit(0.0))
    if told.where(F.col("df") <= bar).where("df > 0").isEmpty():
        return summed.withColumn("cosine", cosine(F.col("_w.dot"), F.col("_w.norm2"))).drop("_w")
    summed = durable(summed.withColumn("_row", F.monotonically_increasing_id()))
    w = (1 + F.ln("tf")) * F.col("idf")
    rare = summed.select("_row", F.inline("_w.cold")).join(told, "term").groupBy("_row").agg(F.sum(w * F.col("wq")).alias("_dot"), F.sum(w * w).alias("_norm2"))
    both = summed.join(rare, "_row", "left").fillna(0.0, ["_dot", "_norm2"])
    return both.withColumn("cosine", cosine(F.col("_w.dot") + F.col("_dot"), F.col("_w.norm2") + F.col("_norm2"))).drop("_w", "_row", "_dot", "_norm2")


def similarity(rows: DataFrame, id_column: str, text: str, other: str, most_hot: int = MOST_HOT) -> DataFrame:
    """id_column and cosine of TF-IDF vectors of each row's text against the text `other`; null texts have 0."""
    own = durable(spread(rows.select(id_column, text), id_column).select(id_column, terms(F.col(text), V.STOP).alias("terms")))
    return with_cosine(own, "terms", other, most_hot).select(id_column, "cosine")


def skill_part(df: DataFrame, taxonomy: S.Taxonomy, profile: Profile) -> DataFrame:
    """`df` (with hits, title_hits, description) and required, preferred, negated, weights, matched, missing, related, keywords and skill_score."""
    soft = taxonomy.soft
    df = df.withColumn("_from", Q.preferred_from(F.col("description")))
    split = lambda fits: let(F.col("_from"), lambda at: F.filter("hits", lambda h: fits(h["line"], at)))
    df = df.withColumns({"req_hits": F.concat(split(lambda line, at: F.coalesce(line < at, F.lit(True))), F.col("title_hits")), "pref_hits": split(lambda line, at: line >= at)})
    df = df.withColumn("required", S.wanted_of(F.col("req_hits"))).withColumn("preferred", F.array_except(S.wanted_of(F.col("pref_hits")), "required"))
    ruled = F.array_union(S.ruled_out_of(F.col("req_hits")), S.ruled_out_of(F.col("pref_hits")))
    df = df.withColumn("negated", F.array_sort(F.array_except(F.array_except(ruled, "required"), "preferred")))
    weigh = lambda names, w: F.transform(names, lambda s: F.struct(s.alias("skill"), F.when(s.isin(*soft) if soft else F.lit(False), 0.5 * w).otherwise(w).alias("weight"), credit_of(s, profile).alias("c")))
    df = df.withColumn("weights", F.concat(weigh("required", 1.0), weigh("preferred", 0.5)))
    named = lambda f: F.array_sort(F.transform(F.filter("weights", f), lambda x: x["skill"]))
    by_keyword = (F.size("required") < MINIMUM["keyword_skills"]) & (F.length("description") >= MINIMUM["keyword_text"])
    own = sorted(set(re.findall(r"[a-z][a-z+#.\-]{2,}", profile.text.lower())))
    df = df.withColumns({
        "matched": named(lambda x: x["c"]["credit"] >= 1), "missing": named(lambda x: x["c"]["credit"] < 1),
        "related": F.transform(F.filter("weights", lambda x: x["c"]["how"].isin("implied", "related")), lambda x: F.struct(x["skill"].alias("skill"), x["c"]["via"].alias("via"), x["c"]["how"].alias("how"))),
        "keywords": F.when(by_keyword, repeated_words(F.col("description"))).otherwise(F.array().cast("array<string>")), "by_keyword": by_keyword,
    })
    sums = lambda f: F.aggregate("weights", F.lit(0.0), lambda s, x: s + f(x))
    skills = F.try_divide(sums(lambda x: x["weight"] * x["c"]["credit"]), sums(lambda x: x["weight"]))
    words = F.try_divide(F.size(F.array_intersect("keywords", F.lit(own).cast("array<string>"))).cast("double"), F.size("keywords"))
    n = F.size("weights")
    both = F.when(words.isNotNull(), (skills * n + words * 3) / (n + 3)).otherwise(skills)
    return df.withColumn("skill_score", F.coalesce(F.when(n > 0, both).otherwise(words), F.lit(0.0))).drop("_from")


def assessed(line: Column, hits: Column, profile: Profile, by: B.Embedder | None = None) -> Column:
    """struct<coverage, missing, how> of one requirement line with the skills named on it, or null if it can't be judged.

    With an embedder the line also has `near`, its best line of the resume, whose credit counts where it is more than the shared terms.
    """
    text = line["text"]
    told = lambda coverage, how, lost=None: F.struct(coverage.cast("double").alias("coverage"), (F.array().cast("array<string>") if lost is None else lost).alias("missing"), how.alias("how"))

    def by_skill(c: Column) -> Column:
        any_of = text.rlike(V.ALTERNATIVES)
        credits_ = F.transform(c, lambda x: x["c"]["credit"])
        mean = F.aggregate(credits_, F.lit(0.0), lambda s, x: s + x) / F.size(c)
        has = lambda how: F.exists(c, lambda x: x["c"]["how"] == how)
        whole = any_of & F.exists(c, lambda x: x["c"]["credit"] >= 1)
        share = F.when(whole, 1.0).when(any_of, F.greatest(mean, F.array_max(credits_))).otherwise(mean)
        kind = F.when(has("related"), "related skill").when(has("implied"), "implied skill").otherwise("exact skill")
        missing = F.when(whole, F.array().cast("array<string>")).otherwise(F.transform(F.filter(c, lambda x: x["c"]["credit"] < 1), lambda x: x["skill"]))
        return told(share, F.when(share > 0, kind).otherwise("not found"), missing)

    need = F.nullif(F.regexp_extract(text, V.YEARS_ON_LINE, 1), F.lit("")).try_cast("double")
    years = F.when(need == 0, 1.0).otherwise(F.least(F.lit(1.0), F.lit(profile.years) / need) if profile.years else F.lit(0.3))
    bar, have = Q.degree_rank(Q.lowest_degree(text)), Q.degree_rank(F.lit(profile.education))
    degree = F.when(have >= bar, 1.0).when(text.rlike(V.DEGREE_SOFTENER), 0.5).otherwise(0.0)
    own = F.lit(sorted(set(_content_terms(profile.text)))).cast("array<string>")
    met = lambda asked: F.size(F.array_intersect(asked, own))
    shared = lambda asked: told(met(asked) / F.size(asked), F.when(met(asked) > 0, "term overlap").otherwise("not found"))
    alike = lambda asked: F.when(by.credit(line["near"]["sim"]) > met(asked) / F.size(asked), told(by.credit(line["near"]["sim"]), F.lit("semantic match"))).otherwise(shared(asked)) if by else shared(asked)
    overlap = lambda asked: F.when(F.size(asked) >= 2, alike(asked))
    rest = F.when(need.isNotNull() & text.rlike(r"(?i)experience|exp\b"), told(years, F.lit("years check"))).when(Q.degree_text(text).rlike(V.DEGREE_CUE), told(degree, F.lit("degree check")))
    credited = F.transform(S.wanted_of(hits), lambda s: F.struct(s.alias("skill"), credit_of(s, profile).alias("c")))
    return let(credited, lambda c: F.when(F.size(c) > 0, by_skill(c)).when(F.size(hits) == 0, rest.otherwise(let(F.array_distinct(terms(text, V.STOP)), overlap))))


def lines_told(rows: DataFrame, profile: Profile, by: B.Embedder | None = None) -> DataFrame:
    """`rows` (line, hits of the line: skill, negated) and told: all that a line says for the scores, whatever text it is in.

    Attributes of `line_told`, terms, hits, and of the line as a requirement and of its strays (own): degree, what `assessed`
    makes of it (a), and with an embedder the nearest line of the resume (evidence).
    """
    df = rows.withColumn("_t", Q.line_told(F.trim("line"), F.size("hits") > 0))
    items = F.when(F.col("_t.head").isNull(), F.concat(F.array("_t.text"), F.transform("_t.strays", lambda p: p["text"]))).otherwise(F.array().cast("array<string>"))  # headings are no requirements
    near = F.lit(None)
    if by:
        df = df.withColumn("_near", B.best_lines_in_row(items, B.worth_comparing([x.strip(" -•*\t") for x in profile.text.splitlines()]), by))
        near = F.col("_near")
    more = (lambda i: [F.get("_near", i)["line"].alias("evidence")]) if by else (lambda i: [])
    line = lambda x, i: F.struct(x.alias("text"), *([F.get(near, i).alias("near")] if by else []))
    own = lambda x, i: F.struct(Q.degree_named(x).alias("degree"), let(line(x, i), lambda y: assessed(y, F.col("hits"), profile, by)).alias("a"), *more(i))
    told = F.struct(*(F.col("_t")[c].alias(c) for c in ("text", "bullet", "head", "plain", "fits", "strays")), (F.trim("line") != "").alias("filled"), G.anchored(F.col("line")).alias("anchored"), terms(F.col("line"), V.STOP).alias("terms"), "hits", F.transform(items, own).alias("own"))
    return df.withColumn("told", told).drop("_t", "_near")


def text_parts(texts: DataFrame, taxonomy: S.Taxonomy, profile: Profile, by: B.Embedder | None = None, **hot: int) -> DataFrame:
    """`texts` (_text, title, description, copies; from the shared folder) and hits (skill, line, negated), title_hits, terms, anchored and title_anchored (of gates) and
    lines, the requirement lines with what `lines_told` says of each, written. The work is done once for each distinct line."""
    lines = F.concat(F.array("title"), F.split("description", "\n"))  # the title ahead, at 0

    def alone(df: DataFrame) -> DataFrame:
        df = durable(df.withColumn("_h", S.hits_on_line(F.col("line"), taxonomy)).select("*", "_h.hits", "_h.open"))
        return lines_told(df, profile, by)

    def within(odd: DataFrame) -> DataFrame:
        df = durable(odd.select("_text", F.split("description", "\n").alias("l"), S.hits_in(S.words_of(F.col("description")), taxonomy).alias("h")))
        df = df.select("_text", "h", F.posexplode("l").alias("at", "line")).select("_text", (F.col("at") + 1).alias("pos"), "line", F.filter("h", lambda h: h["line"] == F.col("at")).alias("h"))
        return lines_told(df.withColumn("hits", F.transform("h", lambda h: F.struct(h["skill"].alias("skill"), h["negated"].alias("negated")))), profile, by)

    df = with_lines(texts, lines, alone, within, **hot)
    placed = lambda t, i: F.transform(t["hits"], lambda h: F.struct(h["skill"].alias("skill"), i.alias("line"), h["negated"].alias("negated")))
    more = {"degree": "struct<level: string, soft: boolean>", "a": "struct<coverage: double, missing: array<string>, how: string>"} | ({"evidence": "string"} if by else {})
    filled = lambda own: F.filter(F.transform(own, lambda t, i: F.struct(i.alias("line"), t.alias("told"))), lambda x: x["told"]["filled"])
    parts = lambda own: F.struct(F.flatten(F.transform(own, placed)).alias("hits"), F.flatten(F.transform(own, lambda t: t["terms"])).alias("terms"), F.flatten(F.transform(own, lambda t: t["anchored"])).alias("anchored"), Q.in_sections(filled(own), more).alias("lines"))
    told = let(F.slice("told", 2, F.greatest(F.lit(1), F.size("told"))), parts)
    heard = F.transform(F.get("told", F.lit(0))["hits"], lambda h: F.struct(h["skill"].alias("skill"), F.lit(0).alias("line"), h["negated"].alias("negated")))
    return durable(df.select("_text", "title", "description", "copies", heard.alias("title_hits"), F.get("told", F.lit(0))["anchored"].alias("title_anchored"), told.alias("_p")).select("_text", "title", "description", "copies", "title_hits", "title_anchored", "_p.*"))


def _content_terms(text: str) -> list[str]:
    """The terms of one resume, as `functions.text.terms` gives them for columns."""
    found = []
    for word in re.findall(r"[a-z][a-z+#.\-]{2,}", text.lower()):
        if word not in V.STOP and len(word) > 3:
            word = word.strip(".-")
            end = next((e for e in ("ing", "ies", "es", "s", "ed") if len(word) > 5 and word.endswith(e)), "")
            found.append(word[: len(word) - len(end)] + ("y" if end == "ies" else ""))
    return found


def scored(postings: DataFrame, taxonomy: S.Taxonomy, profile: Profile, by: B.Embedder | None = None) -> DataFrame:
    """`scored_texts`, joined: a row for each posting."""
    return with_scores(*scored_texts(postings, taxonomy, profile, by))


def with_scores(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Postings (id, source, company, location, _text) with the scores of their texts."""
    both = rows.join(texts, "_text")
    return both.select("id", "source", "company", "location", *(c for c in texts.columns if c != "_text"))


def scored_texts(postings: DataFrame, taxonomy: S.Taxonomy, profile: Profile, by: B.Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """The postings, and the scores of each distinct title and description, by _text; a text that stands in many postings is worked on once.

    Each posting with its score of 0 to 100, the components, and what they rest on.

    id, source, company, location, title, required, preferred, matched, missing, negated, related, keywords, requirement_rows
    (id, text, preferred, coverage, missing, how, status), requirements_met, required_years, years_inferred, education
    (level, strict, text), gates (judged), blockers, penalty, capped, the five components, score, confidence. All but the
    similarity of terms is worked out within the row. A null description counts as empty. Of rows that share an id the last
    by its columns counts. With an embedder `by`, lines that name no skill are also held against the resume's lines by
    meaning (how: semantic match), and requirement_rows has `evidence`, the nearest of these lines.
    """
    base = postings.select("id", "source", "company", "location", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("description", F.lit("")).alias("description"))
    once = only_once(durable(base.withColumn("_text", text_key("title", "description"))), "id")
    texts = durable(distinct_texts(once, "title", "description"))
    base = text_parts(texts, taxonomy, profile, by)  # steps are written, so that no later step works an earlier one out again for each of its uses
    df = skill_part(base.withColumn("stated", G.detected(F.col("description"), F.col("title"), None, F.col("anchored"), F.col("title_anchored"))), taxonomy, profile).drop("hits", "title_hits", "req_hits", "pref_hits", "anchored", "title_anchored")
    told = let(F.struct(F.col("stated").alias("g"), F.col("lines").alias("x")), lambda s: F.filter(s["x"], lambda x: x["a"].isNotNull() & ~G.is_gate_line(x["text"], s["g"])))
    df = df.withColumn("rows", F.transform(told, lambda x, i: F.struct(
        F.concat(F.lit("r"), (i + 1).cast("string")).alias("id"), x["text"].alias("text"), x["preferred"].alias("preferred"), x["a"]["coverage"].alias("coverage"),
        x["a"]["missing"].alias("missing"), x["a"]["how"].alias("how"), Q.status_of(x["a"]["coverage"]).alias("status"), *([x["evidence"].alias("evidence")] if by else []),
    )))
    df = durable(df.withColumns({"years": Q.required_years(F.col("title"), F.col("description")), "education": Q.required_education(F.col("lines"))}).drop("lines"))
    discard(base, texts)
    df = with_cosine(df, "terms", profile.text, copies="copies")
    lacks = F.coalesce(Q.degree_rank(F.col("education.level")) > Q.degree_rank(F.lit(profile.education)), F.lit(False))
    degree = F.when(lacks & F.col("education.strict"), F.concat(F.lit("Requires a "), F.col("education.level"), F.lit(" degree"))).when(lacks, F.concat(F.lit("Prefers a "), F.col("education.level"), F.lit(" degree")))
    few = ~F.col("years.inferred") & F.lit(profile.years > 0) & (F.lit(profile.years) < 0.6 * F.col("years.years"))
    blockers = F.array_compact(F.array(degree, F.when(few, "More years of experience than the resume shows")))
    short = F.length("description") < MINIMUM["text"]
    parts = {
        "skills": F.col("skill_score"), "requirements": F.coalesce(Q.coverage_of(F.col("rows")), "skill_score"), "role": title_fit(F.col("title"), profile.text, profile.head),
        "experience": experience_score(F.col("years.years"), profile.years), "semantic": F.least(F.lit(1.0), F.col("cosine") / 0.30),
    }
    df = df.withColumns({"blockers": blockers, "penalty": F.when(lacks & F.col("education.strict"), 0.08).when(lacks, 0.02).otherwise(0.0), **parts})
    judged = F.concat(G.judged(F.col("stated"), profile.eligibility, profile.text), G.degree_gate(F.col("education"), F.lit(profile.education), Q.degree_rank))
    unsure = short | ((F.size("weights") == 0) & ~F.col("by_keyword") & (F.size("rows") == 0))
    return once.drop("title", "description"), df.select(
        "_text", "title", "required", "preferred", "matched", "missing", "negated", "related", "keywords", F.col("rows").alias("requirement_rows"),
        F.size(F.filter("rows", lambda r: r["status"] == "met")).alias("requirements_met"), F.col("years.years").alias("required_years"), F.col("years.inferred").alias("years_inferred"), "education",
        judged.alias("gates"), "blockers", "penalty", short.alias("capped"), *parts, total_score({k: F.col(k) for k in parts}, F.col("penalty"), short).alias("score"), F.when(unsure, "low").otherwise("high").alias("confidence"),
    )


def failed_gates(scores: DataFrame) -> DataFrame:
    """`scores` with failed: distinct labels of gates that fail."""
    return scores.withColumn("failed", F.array_distinct(F.transform(F.filter("gates", lambda g: g["status"] == "fail"), lambda g: g["label"])))


def standing(threshold: int, near: int = 15) -> Column:
    """qualified, gate (enough, but a gate fails), near (at most `near` short) or below, of rows with score and failed."""
    enough = F.col("score") >= threshold
    return F.when(enough & (F.size("failed") == 0), "qualified").when(enough, "gate").when(F.col("score") >= threshold - near, "near").otherwise("below")


def report(scores: DataFrame, threshold: int) -> DataFrame:
    """One row: job_count, avg_score, qualifying, score_qualifying, gate_failed and a five-bucket distribution."""
    bucket = F.least(F.lit(4), F.floor(F.col("score") / 20).cast("int"))
    enough, free = F.col("score") >= threshold, F.size("failed") == 0
    return failed_gates(scores).agg(
        F.count("*").alias("job_count"), F.coalesce(F.bround(F.avg("score")).cast("int"), F.lit(0)).alias("avg_score"), F.count_if(enough & free).alias("qualifying"),
        F.count_if(enough).alias("score_qualifying"), F.count_if(enough & ~free).alias("gate_failed"), *(F.count_if(bucket == k).alias(f"bucket_{k}") for k in range(5)),
    )


def gate_breakdown(scores: DataFrame, threshold: int) -> DataFrame:
    """label, failed (postings of enough score that fail such a gate), unknown (gates of all postings that can't be settled)."""
    each = scores.select("score", F.explode("gates").alias("g"), F.col("id"))
    failed = each.where((F.col("g.status") == "fail") & (F.col("score") >= threshold)).groupBy("g.label").agg(F.count_distinct("id").alias("failed"))
    open_ = each.where(F.col("g.status") == "unknown").groupBy("g.label").agg(F.count("*").alias("unknown"))
    return failed.join(open_, "label", "full").select("label", F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("unknown", F.lit(0)).alias("unknown"))


def skill_demand(scores: DataFrame, profile: Profile, gaps: int = 15, strengths: int = 12) -> DataFrame:
    """kind (gap, strength), skill, jobs, pct: skills most often missing, and owned ones most often asked for; ties by name."""
    n = scores.count()
    each = scores.select(F.explode(F.concat(F.transform("matched", lambda s: F.struct(s.alias("skill"), F.lit(0).alias("gap"))), F.transform("missing", lambda s: F.struct(s.alias("skill"), F.lit(1).alias("gap"))))).alias("x"))
    demand = each.groupBy("x.skill").agg(F.count("*").alias("n"), F.sum("x.gap").alias("gap"))
    top = lambda kind, jobs, most: demand.where(jobs > 0).select(F.lit(kind).alias("kind"), "skill", jobs.alias("jobs")).orderBy(F.desc("jobs"), "skill").limit(most)
    lost = top("gap", F.col("gap"), gaps)
    kept = top("strength", F.when(F.col("skill").isin(*profile.skills), F.col("n") - F.col("gap")).otherwise(0), strengths)
    return lost.unionByName(kept).withColumn("pct", F.bround(100 * F.col("jobs") / F.lit(max(1, n))).cast("int"))


def unused_skills(scores: DataFrame, profile: Profile) -> DataFrame:
    """skill: those of the profile that no posting asks for."""
    own = scores.sparkSession.createDataFrame([(s,) for s in profile.skills], "skill string")
    return own.join(scores.select(F.explode(F.concat("matched", "missing")).alias("skill")).distinct(), "skill", "left_anti")


def common_blockers(scores: DataFrame, most: int = 5) -> DataFrame:
    """text, jobs: the most frequent blockers; ties by text."""
    return scores.select(F.explode("blockers").alias("text")).groupBy("text").agg(F.count("*").alias("jobs")).orderBy(F.desc("jobs"), "text").limit(most)


def rescored(before: DataFrame, after: DataFrame, threshold: int) -> DataFrame:
    """One row that compares two scorings of the same postings: jobs, raised, lowered, unlocked (newly enough), mean_change."""
    both = before.select("id", F.col("score").alias("a")).join(after.select("id", F.col("score").alias("b")), "id")
    gain = F.col("b") - F.col("a")
    return both.agg(F.count("*").alias("jobs"), F.count_if(gain > 0).alias("raised"), F.count_if(gain < 0).alias("lowered"), F.count_if((F.col("a") < threshold) & (F.col("b") >= threshold)).alias("unlocked"), F.avg(gain).alias("mean_change"))
