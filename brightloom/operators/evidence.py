"""Quotes as evidence: whether they stand in a resume, bear on a requirement, and what they make of a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.phrases import evidence_stems, jaccard
from ..functions.text import let
from .matching import total_score
from .requirements import coverage_of, education_level, status_of

# --- fixed values: shares, durations -----------------------------------------------------------------------------------
PRESENT, WITHIN, ALIKE = 0.85, 0.75, 0.6
DURATION = r"(?i)\d+\s*\+?\s*(?:years?|yrs?)\b"
DATES = r"(?i)(?:19|20)\d{2}\s*(?:-|–|—|to)\s*(?:(?:19|20)\d{2}|present|current)"
SMALL_WORDS = "a an the and or of in to with for".split()
COVERAGE = {"met": 1.0, "partial": 0.5, "missing": 0.0}


def plain(text: Column) -> Column:
    """Lower-case words, numbers and the signs + # % $ . with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9+#%$.]+", " "), r"\s+", " "))


def stands_in(quote: Column, resume: Column) -> Column:
    """Whether a quote stands in a resume: as a whole, or five of its words in a row with nearly all words there."""

    def told(q: Column, r: Column) -> Column:
        words = F.split(q, " ")
        there = F.size(F.filter(words, lambda w: F.array_contains(F.split(r, " "), w))) / F.size(words)
        run = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - 4)), lambda k: F.contains(r, F.array_join(F.slice(words, k, 5), " ")))
        return F.when(F.length(q) < 4, False).when(F.contains(r, q), True).when(F.size(words) < 5, False).otherwise((there >= PRESENT) & run)

    return let(plain(quote), lambda q: let(plain(resume), lambda r: told(q, r)))


def bears_on(quote: Column, requirement: Column, quote_skills: Column, required_skills: Column) -> Column:
    """Whether a quote is about a requirement: it names one of its skills, or shares most of its stems; a bare duration needs one."""
    degree = F.array(F.lit("<degree>"))
    asks = requirement.rlike(V.DEGREE_CUE)
    req = F.when(asks, F.concat(F.array_except(evidence_stems(requirement), evidence_stems(F.lit("degree bachelor bachelors master masters"))), degree)).otherwise(evidence_stems(requirement))
    has = quote.rlike(V.DEGREE_CUE) | education_level(quote).isNotNull()
    own = F.when(has, F.concat(evidence_stems(quote), degree)).otherwise(evidence_stems(quote))
    named = F.size(required_skills) > 0

    def told(r: Column, q: Column) -> Column:
        shared, half = F.size(F.array_intersect(r, q)), F.floor((F.size(r) + 1) / 2)
        enough = F.when(named, shared >= F.greatest(F.lit(2), half)).otherwise(shared >= F.least(F.greatest(F.lit(1), half), F.size(r)))
        bare = F.when(requirement.rlike(DURATION), quote.rlike(DURATION) | quote.rlike(DATES)).otherwise(~named)
        return F.when(F.size(r) == 0, bare).otherwise(enough)

    return F.when(F.arrays_overlap(quote_skills, required_skills), True).otherwise(let(req, lambda r: let(own, lambda q: told(r, q))))


def judged(status: Column, quote: Column, found: Column, relevant: Column) -> Column:
    """struct<status, verified, flag>: a claim without a quote that is found and bears on it goes down a step."""
    known = F.when(status.isin(*COVERAGE), status).otherwise("missing")
    claims = known.isin("met", "partial")
    verified = claims & found & relevant
    lower = F.when(known == "met", "partial").otherwise("missing")
    flag = F.when(F.coalesce(quote, F.lit("")) == "", "no resume evidence given").when(~found, "quote not found in the resume").otherwise("quote doesn't relate to the requirement")
    return F.struct(F.when(claims & ~verified, lower).otherwise(known).alias("status"), verified.alias("verified"), F.when(claims & ~verified, flag).otherwise("").alias("flag"))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9+#]+"), F.lit(0)), lambda w: ~w.isin(*SMALL_WORDS)))


def span_verified(text: Column, description: Column, skills: Column) -> Column:
    """Whether a line or sentence of the description holds most of the words of `text`; of a single word only a skill's name will do."""
    lines = F.transform(F.split(description, "\n"), lambda x: F.regexp_replace(F.trim(x), V.BULLET, ""))
    units = F.concat(lines, F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.;!?])\s+"))))

    def told(t: Column) -> Column:
        within = lambda u: (F.size(F.array_intersect(t, u)) / F.size(t) >= WITHIN) | (jaccard(t, u) >= ALIKE)
        return F.when(F.size(t) == 0, False).when(F.size(t) == 1, (F.size(skills) > 0) & F.exists(units, lambda u: F.array_contains(tokens(u), t[0]))).otherwise(F.exists(units, lambda u: within(tokens(u))))

    return let(tokens(text), told)


def fingerprint(title: Column, description: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit(""))), 256), 1, 16)


def combined(scores: DataFrame, judgments: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """id, det_score, final_score, verified, assessed, disagreements: scores with requirement lines that judgments (id, text, status, verified) replace.

    Judgments and overrides (id, text) go by a line's text, as its number may change; a person's override beats a judgment.
    The score is worked out anew from components of whole percents. Several judgments of a line: the first by status.
    """
    lines = scores.select("id", F.posexplode("requirement_rows").alias("n", "r")).select("id", "n", "r.text", "r.preferred", "r.coverage", "r.status")
    told = judgments.groupBy("id", "text").agg(F.min(F.struct(F.col("status").alias("ai_status"), "verified")).alias("j")).select("id", "text", "j.*")
    rows = lines.join(told, ["id", "text"], "left")
    rows = rows.join(overrides.select("id", "text", F.lit(True).alias("own")).distinct(), ["id", "text"], "left") if overrides is not None else rows.withColumn("own", F.lit(None).cast("boolean"))
    share = F.element_at(F.create_map(*(F.lit(x) for pair in COVERAGE.items() for x in pair)), F.col("ai_status"))
    used = F.coalesce(F.col("verified") & F.col("own").isNull(), F.lit(False))
    rows = rows.withColumn("final", F.when(used, share).otherwise(F.col("coverage")))
    per = rows.groupBy("id").agg(
        F.collect_list(F.struct("preferred", F.col("final").alias("coverage"))).alias("rows"), F.count_if("verified").alias("verified"), F.count("ai_status").alias("assessed"),
        F.count_if(F.col("ai_status") != F.col("status")).alias("disagreements"), F.count_if(status_of(F.col("final")) == "met").alias("met"),
    )
    whole = {k: F.bround(F.col(k) * 100) / 100 for k in ("skills", "requirements", "role", "experience", "semantic")}
    both = scores.select("id", "score", "penalty", "capped", *(c.alias(k) for k, c in whole.items())).join(per, "id", "left")
    parts = {k: F.col(k) for k in whole} | {"requirements": F.coalesce(coverage_of(F.col("rows")), "requirements")}
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("id", F.col("score").alias("det_score"), total_score(parts, F.col("penalty"), F.col("capped")).alias("final_score"), zero("verified"), zero("assessed"), zero("disagreements"), zero("met"))
