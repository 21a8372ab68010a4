"""What a posting asks for: requirement lines, years, degrees, and how a line is met by a profile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import let, terms

MOST_LINES = 25
SENTENCE = r"(?<=[.!?;])\s+(?=[A-Z0-9•(])"


def preferred_from(description: Column) -> Column:
    """Number of the line, from 0, where what is merely preferred begins, or null: a heading behind the first 15 % of the text."""
    at = F.regexp_instr(description, F.lit(V.PREFERRED_HEADING))
    before = F.substring(description, F.lit(1), at - 1)
    blank = F.regexp_extract(F.substring(description, at, F.length(description)), r"^\s*", 0)
    return F.when((at > 0) & (at - 1 > 0.15 * F.length(description)), F.size(F.split(F.concat(before, blank), "\n")) - 1)


def line_told(raw: Column, skill: Column) -> Column:
    """struct<text, bullet, head, plain, fits, strays (text, preferred)>: what the lines' patterns say of one trimmed line, each tried once.

    `skill` says whether the line names one.
    """
    bullet = raw.rlike(V.BULLET)

    def attributes(t: Column) -> Column:
        n = F.length(t)
        short = ~bullet & (n <= 70) & (t.endswith(":") | (F.size(F.split(t, r"\s+")) <= 7))
        head = F.when(short & t.rlike(V.PREFERRED_HEAD), "pref").when(short & t.rlike(V.SKIPPED_HEAD), "skip").when(short & t.rlike(V.REQUIRED_HEAD), "req")
        plain = ~bullet & ((n > 100) | F.contains(t, F.lit(". "))) & ~t.rlike(V.REQUIREMENT_CUE) & ~skill
        fits = n.between(2, 320) & ((n >= 15) | skill | (F.size(terms(t, V.STOP)) > 0))
        parts = F.when(n > 160, F.split(t, SENTENCE)).otherwise(F.array(t))
        stray = F.filter(F.transform(parts, F.trim), lambda p: F.length(p).between(15, 320) & p.rlike(V.REQUIREMENT_CUE))
        strays = F.transform(stray, lambda p: F.struct(F.regexp_replace(p, r"\.+$", "").alias("text"), p.rlike(V.PREFERRED_HEAD).alias("preferred")))
        return F.struct(t.alias("text"), bullet.alias("bullet"), head.alias("head"), plain.alias("plain"), fits.alias("fits"), strays.alias("strays"))

    return let(F.trim(F.regexp_replace(raw, V.BULLET, "")), attributes)


def in_sections(lines: Column, more: dict[str, str] | None = None) -> Column:
    """array<struct<text, preferred, line, *more>>, at most MOST_LINES, from array<struct<line, told>> of lines that aren't blank.

    `told` is of `line_told`, with an array `own` of what `more` (name, type) says of the line itself and of its strays in order.
    """
    more = more or {}
    kinds = "array<struct<text: string, preferred: boolean, line: int" + "".join(f", {k}: {t}" for k, t in more.items()) + ">>"
    besides = lambda x, i: [F.get(x["told"]["own"], i)[k].alias(k) for k in more]

    def step(s: Column, x: Column) -> Column:
        told = x["told"]
        inside = s["section"].isin("req", "pref")
        prose = inside & told["plain"] & (s["bullets"] > 0)
        fits = inside & ~prose & told["fits"]
        opens = told["head"].isNotNull()
        item = F.struct(told["text"].alias("text"), (s["section"] == "pref").alias("preferred"), x["line"].alias("line"), *besides(x, F.lit(0)))
        strays = F.transform(told["strays"], lambda p, i: F.struct(p["text"].alias("text"), p["preferred"].alias("preferred"), x["line"].alias("line"), *besides(x, i + 1)))
        return F.struct(
            F.when(opens, told["head"]).when(prose, "").otherwise(s["section"]).alias("section"),
            F.when(opens, 0).when(fits & told["bullet"], s["bullets"] + 1).otherwise(s["bullets"]).alias("bullets"),
            (s["found"] | F.coalesce(told["head"] == "req", F.lit(False))).alias("found"),
            F.when(~opens & fits, F.concat(s["kept"], F.array(item))).otherwise(s["kept"]).alias("kept"),
            F.when(~opens & (s["section"] == ""), F.concat(s["loose"], strays)).otherwise(s["loose"]).alias("loose"),
        ).cast(state)

    def last(s: Column) -> Column:
        own = s["found"] | F.exists(s["kept"], lambda x: x["preferred"])
        return F.slice(F.when(own, s["kept"]).otherwise(F.concat(s["loose"], s["kept"])), 1, MOST_LINES)

    state = f"struct<section: string, bullets: int, found: boolean, kept: {kinds}, loose: {kinds}>"
    empty = F.struct(F.lit("").alias("section"), F.lit(0).alias("bullets"), F.lit(False).alias("found"), F.array().cast(kinds).alias("kept"), F.array().cast(kinds).alias("loose")).cast(state)
    return F.aggregate(lines, empty, step, last)


def requirement_lines(description: Column, named: Column) -> Column:
    """array<struct<text, preferred, line>>, at most MOST_LINES.

    Lines under a heading of requirements or preferences, until another heading or prose behind bullets. Without either,
    lines or sentences anywhere that speak of a requirement come ahead. `named` holds the numbers of lines that name a skill.
    """
    stripped = F.transform(F.split(F.coalesce(description, F.lit("")), "\n"), lambda x, i: F.struct(F.trim(x).alias("raw"), i.alias("line")))
    told = lambda x, known: F.struct(x["line"].alias("line"), line_told(x["raw"], F.array_contains(known, x["line"])).alias("told"))
    return in_sections(let(named, lambda known: F.transform(F.filter(stripped, lambda x: x["raw"] != ""), lambda x: told(x, known))))


def required_years(title: Column, description: Column) -> Column:
    """struct<years: double, inferred: boolean>: the least stated number from 1 to 20, else what the title's seniority says, or null."""
    found = F.regexp_extract_all(F.coalesce(description, F.lit("")), F.lit(V.YEARS_ASKED), F.lit(0))
    number = lambda m: F.concat(*(F.regexp_extract(m, V.YEARS_ASKED, k) for k in (1, 2)))  # noqa: E731 (one of the two is empty)
    stated = F.transform(found, lambda m: F.nullif(number(m), F.lit("")).try_cast("double"))
    least = F.array_min(F.filter(stated, lambda n: n.between(1, 20)))
    senior = F.lit(None).cast("double")
    for pattern, years in reversed(V.SENIORITY_YEARS):
        senior = F.when(title.rlike(pattern), float(years)).otherwise(senior)
    return F.struct(F.coalesce(least, senior).alias("years"), least.isNull().alias("inferred"))


def degree_text(text: Column) -> Column:
    """The text without masters that aren't degrees."""
    return F.regexp_replace(text, V.NO_DEGREE, " ")


def education_level(text: Column) -> Column:
    """The highest degree that a text names, or null."""
    plain, level = degree_text(text), F.lit(None).cast("string")
    for name, _, pattern in reversed(V.DEGREES):
        level = F.when(plain.rlike(pattern), name).otherwise(level)
    return level


def lowest_degree(text: Column) -> Column:
    """The lowest degree that a degree line names; a line that only has a cue means a bachelor's."""
    plain, level = degree_text(text), F.lit("Bachelor's")
    for name, _, pattern in V.DEGREES:
        level = F.when(plain.rlike(pattern), name).otherwise(level)
    return level


def degree_rank(name: Column) -> Column:
    rank = F.lit(0)
    for level, n, _ in V.DEGREES:
        rank = F.when(name == level, n).otherwise(rank)
    return rank


def degree_named(text: Column) -> Column:
    """struct<level, soft> of a line that speaks of a degree, or null."""
    return F.when(degree_text(text).rlike(V.DEGREE_CUE), F.struct(lowest_degree(text).alias("level"), degree_text(text).rlike(V.DEGREE_SOFTENER).alias("soft")))


def required_education(lines: Column) -> Column:
    """struct<level, strict, text> of the first line (text, preferred, degree of `degree_named`) that speaks of a degree, or null; strict if nothing softens it."""
    told = lambda x: F.struct(x["degree"]["level"].alias("level"), (~x["preferred"] & ~x["degree"]["soft"]).alias("strict"), x["text"].alias("text"))
    return F.get(F.transform(F.slice(F.filter(lines, lambda x: x["degree"].isNotNull()), 1, 1), told), F.lit(0))


def status_of(coverage: Column) -> Column:
    return F.when(coverage >= 0.75, "met").when(coverage >= 0.35, "partial").otherwise("missing")


def coverage_of(rows: Column) -> Column:
    """Weighted mean of `coverage` over array<struct<preferred, coverage, ...>>: what is preferred counts half; null for none."""
    weight = lambda r: F.when(r["preferred"], 0.5).otherwise(1.0)
    total = lambda f: F.aggregate(rows, F.lit(0.0), lambda s, r: s + f(r))
    return F.try_divide(total(lambda r: weight(r) * r["coverage"]), total(weight))
