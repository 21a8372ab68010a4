"""What a report says in sentences, by fixed rules: strengths, what to improve, and skills to learn."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import Profile, skill_demand, unused_skills

# --- fixed values: how many of each, what falls short, and the sentences --------------------------------------------------
STRENGTHS, GAPS, NAMED, UNUSED = 5, 6, 5, 8
ENOUGH, FAR, WEAK = 60, 0.70, 0.40  #: a score worth naming; an experience and a role component that fall short
ASKED_FOR = "{skill} is requested in {pct}% of these postings and it's on your resume."
YEARS = "About {years} years of experience detected on your resume."
BEST = "Strongest fit: {title} at {company} ({score}%)."
NO_STRENGTH = "No strong overlaps found yet — see the skills to build below."
CLOSE_GAPS = "Close the most frequent skill gaps: {skills}."
MORE_YEARS = "{n} postings ask for more experience than your resume shows — make dates and scope of past roles explicit, and quantify impact."
NAME_THE_ROLE = "Your resume rarely mentions the role words from '{sought}' postings — add a headline/summary that names the target role."
LITTLE_TEXT = "{n} postings had too little text to score reliably; treat their scores as rough."
SPARE = "Skills on your resume that these postings don't ask for: {skills}. Keep them only if relevant to your target roles."
LEARN = "Missing from your resume but mentioned in {pct}% of postings ({jobs} of {n})."


def filled(sentence: str, **parts: Column) -> Column:
    """The sentence with a column for each name in braces."""
    cells = [parts[x] if k % 2 else F.lit(x) for k, x in enumerate(re.split(r"\{(\w+)\}", sentence)) if x]
    return F.concat(*cells)


def whole(c: Column) -> Column:
    return c.cast("long").cast("string")


def insights(scores: DataFrame, profile: Profile, sought: str = "these") -> DataFrame:
    """kind (strength, improvement, skill), place from 1, skill (for skills) and text, of all scores of one profile.

    Each sentence comes from an aggregate, so nothing but a few rows is gathered. Without scores the one strength tells that
    there is no overlap yet. Ties of the best posting go to the first title, then company, by name.
    """
    demand = skill_demand(scores, profile)
    none = F.lit(None).cast("string")
    best = F.min_by(F.struct("title", "company", "score"), F.struct(-F.col("score"), F.col("title"), F.col("company")))
    short = F.col("required_years").isNotNull() & (F.col("required_years") != 0) & (F.bround(F.col("experience") * 100) < FAR * 100)
    sums = scores.agg(F.count("*").alias("n"), best.alias("best"), F.count_if(short).alias("short"), F.count_if(F.bround(F.col("role") * 100) < WEAK * 100).alias("weak"), F.count_if(F.col("confidence") == "low").alias("low"))
    row = lambda kind, place, skill, text: F.struct(F.lit(kind).alias("kind"), place.cast("int").alias("place"), skill.alias("skill"), text.alias("text"))
    listed = lambda kind, most: demand.where(F.col("kind") == kind).orderBy(F.desc("jobs"), "skill").limit(most)
    in_order = lambda df: df.agg(F.array_sort(F.collect_list(F.struct((-F.col("jobs")).alias("o"), "skill", "jobs", "pct"))).alias("s"))
    strong, gaps = in_order(listed("strength", STRENGTHS)).withColumnRenamed("s", "strong"), in_order(listed("gap", GAPS)).withColumnRenamed("s", "gaps")
    spare = unused_skills(scores, profile).agg(F.slice(F.array_sort(F.collect_list("skill")), 1, UNUSED).alias("spare"))
    facts = sums.crossJoin(strong).crossJoin(gaps).crossJoin(spare)  # one row each

    some = lambda test, text: F.when(test, F.array(text)).otherwise(F.array().cast("array<string>"))
    good = F.concat(
        F.transform("strong", lambda s: filled(ASKED_FOR, skill=s["skill"], pct=whole(s["pct"]))), some(F.lit(profile.years > 0), filled(YEARS, years=F.lit(f"{profile.years:.0f}"))),
        some(F.coalesce(F.col("best.score") >= ENOUGH, F.lit(False)), filled(BEST, title=F.col("best.title"), company=F.col("best.company"), score=whole(F.col("best.score")))),
    )
    good = F.when(F.size(good) > 0, good).otherwise(F.array(F.lit(NO_STRENGTH)))
    better = F.array_compact(F.array(
        F.when(F.size("gaps") > 0, filled(CLOSE_GAPS, skills=F.array_join(F.transform(F.slice("gaps", 1, NAMED), lambda g: g["skill"]), ", "))),
        F.when((F.col("short") > 0) & F.lit(profile.years > 0), filled(MORE_YEARS, n=whole(F.col("short")))), F.when(F.col("weak") > F.col("n") / 2, filled(NAME_THE_ROLE, sought=F.lit(sought))),
        F.when(F.col("low") > 0, filled(LITTLE_TEXT, n=whole(F.col("low")))), F.when(F.size("spare") > 0, filled(SPARE, skills=F.array_join("spare", ", "))),
    ))
    learn = F.transform("gaps", lambda g, i: row("skill", i + 1, g["skill"], filled(LEARN, pct=whole(g["pct"]), jobs=whole(g["jobs"]), n=whole(F.col("n")))))
    every = F.concat(F.transform(good, lambda t, i: row("strength", i + 1, none, t)), F.transform(better, lambda t, i: row("improvement", i + 1, none, t)), learn)
    return facts.select(F.inline(every))
