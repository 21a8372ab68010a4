"""Search intents in free text: a small grammar gives the title, its usual variants and look-alikes, the place, the level and the workplace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.phrases import title_case
from ..functions.text import core_tokens, let
from .funnel import Query

# --- fixed values: titles that mean one role, look-alikes, words of level, workplace and place ----------------------------
SAME_ROLE = [
    ["machine learning engineer", "ml engineer", "applied scientist", "ai engineer", "deep learning engineer"],
    ["data engineer", "big data engineer", "etl developer", "data platform engineer", "analytics engineer"],
    ["data scientist", "machine learning scientist", "applied scientist", "quantitative analyst"],
    ["data analyst", "business intelligence analyst", "bi analyst", "reporting analyst", "insights analyst"],
    ["software engineer", "software developer", "backend engineer", "full stack engineer", "application developer"],
    ["frontend engineer", "front end developer", "ui engineer", "react developer", "web developer"],
    ["devops engineer", "site reliability engineer", "platform engineer", "cloud engineer", "infrastructure engineer"],
    ["product manager", "product owner", "technical product manager"],
    ["ux designer", "product designer", "ui ux designer", "interaction designer"],
    ["registered nurse", "staff nurse", "rn", "clinical nurse"],
    ["accountant", "staff accountant", "financial accountant", "management accountant"],
    ["teacher", "secondary school teacher", "classroom teacher", "subject teacher"],
]
LOOK_ALIKES = {"engineer": ["sales engineer", "field service engineer"], "analyst": ["financial analyst"], "developer": ["business developer"], "designer": ["interior designer"]}
LEVELS = [(r"\b(intern|internship)\b", "internship"), (r"\b(junior|entry|graduate|new grad)\b", "entry"), (r"\b(senior|sr\.?|lead|staff|principal)\b", "mid_senior"), (r"\b(director|head of)\b", "director")]
WORKPLACES = [(r"\bremote\b", "remote"), (r"\bhybrid\b", "hybrid"), (r"\bon-?site|in office\b", "on_site")]
PLACE = r"\b(?:in|near|around|based in)\s+([A-Z][\w .'-]+?)(?:\s+or\s+remote|\s*[,;(]|$)"
ROLE_ENDS = r"\b(?:in|near|around|based in|or remote|remote|,)\b"
NO_ROLE = r"\b(senior|sr\.?|junior|lead|staff|principal|entry[- ]level|graduate|jobs?|roles?|positions?)\b"
PLAN = "title, alt_titles, exclude_titles, seniority, location, workplace"


def role_key(title: Column) -> Column:
    """A title's core tokens, whatever their order."""
    return F.array_join(F.array_sort(core_tokens(title)), " ")


def found_in(low: Column, rules: list[tuple[str, str]]) -> Column:
    return F.array_sort(F.array_compact(F.array(*(F.when(low.rlike(pattern), name) for pattern, name in rules))))


def planned(intents: DataFrame, text: str) -> DataFrame:
    """`intents` with struct `plan`: title, alt_titles, exclude_titles, seniority, location, workplace of each free text.

    The role is what stands ahead of the first place or workplace, without words of level; a text that has none of it is
    the title itself, up to 60 letters. A null or empty text has an empty title. The driver works out the keys of the
    fixed titles, some fifty.
    """
    names = intents.sparkSession.createDataFrame([(k, t) for k, group in enumerate(SAME_ROLE) for t in group], "k int, t string")
    number: dict[str, int] = {}
    for r in names.select("k", "t", role_key(F.col("t")).alias("key")).orderBy(F.desc("k")).collect():
        number |= {f"t:{r.t}": r.k, f"k:{r.key}": r.k}  # of a title in two groups the first
    groups = F.create_map(*(F.lit(x) for pair in number.items() for x in pair))
    others = F.array(*(F.lit(sorted(g)) for g in SAME_ROLE))

    def alike(role: Column) -> Column:
        at = F.least(F.try_element_at(groups, F.concat(F.lit("t:"), role)), F.try_element_at(groups, F.concat(F.lit("k:"), role_key(role))))
        return F.coalesce(F.filter(F.get(others, at), lambda t: t != role), F.array().cast("array<string>"))

    def told(low: Column, role: Column) -> Column:
        named = lambda some, most: F.transform(F.slice(some, 1, most), title_case)
        words = F.split(role, " ")
        against = F.flatten(F.array(*(F.when(F.array_contains(words, w), F.filter(F.lit(es), lambda e: e != role)).otherwise(F.array().cast("array<string>")) for w, es in LOOK_ALIKES.items())))
        place = F.trim(F.regexp_extract(F.trim(F.col(text)), PLACE, 1))
        where = F.when(place != "", place).when(low.rlike(WORKPLACES[0][0]), "Remote").otherwise("")
        return F.struct(title_case(role).alias("title"), named(alike(role), 8).alias("alt_titles"), named(against, 5).alias("exclude_titles"), found_in(low, LEVELS).alias("seniority"), where.alias("location"), found_in(low, WORKPLACES).alias("workplace"))

    low = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    role = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(F.element_at(F.split(x, ROLE_ENDS), 1), NO_ROLE, " "), r"\s+", " "), F.lit(" ,.-"))
    whole = intents.withColumn("_low", low).withColumn("_role", let(role(F.col("_low")), lambda r: F.when(r == "", F.substring("_low", 1, 60)).otherwise(r)))
    return whole.withColumn("plan", told(F.col("_low"), F.col("_role"))).drop("_low", "_role")


def query_of(plan: Row, now: str, **more) -> Query:
    """The funnel's query of one plan; `more` sets what a plan doesn't say."""
    away = {"on_site": "onsite"}
    return Query(
        title=plan.title, now=now, location=plan.location, alternatives=tuple(plan.alt_titles), excluded=tuple(plan.exclude_titles), experience=tuple(plan.seniority),
        workplace=tuple(away.get(w, w) for w in plan.workplace), **more,
    )
