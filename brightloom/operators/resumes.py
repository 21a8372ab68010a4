"""Resumes in parts: sections, roles with their bullets, schools, evidence of skills, a check of form, and a person's corrections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable, of_each_text
from ..functions.phrases import header_parts, month_label, months_between
from ..functions.text import let
from ..functions.values import BULLET, ROLE_WORD
from .profiles import RANGE, month_index
from .records import merged_months
from .requirements import education_level
from .skills import Taxonomy, hits_in, wanted_of, words_of

# --- fixed values: headings, names, contacts, schools, measures ------------------------------------------------------------
WORK_HEAD = r"(?i)^(?:professional |work |relevant |employment |career |industry )?(?:experience|employment(?: history)?|work history|career history|professional background|internships?|work experience)\s*:?$"
OTHER_HEAD = (
    r"(?i)^(?:education(?:al background)?|academic.*|qualifications|(?:personal |academic |key )?projects|certifications?(?: & licenses)?|licenses|publications|awards|honou?rs|volunteer(?:ing| experience)?|"
    r"(?:technical |core |key )?skills|interests|hobbies|languages|summary|profile|objective|references|achievements|activities|training|courses|coursework)\s*:?$"
)
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PHONE = r"(?<!\w)\+?\d[\d\s().-]{7,}\d"
LINK = r"(?i)(?:https?://|www\.)\S+|\b(?:linkedin|github)\.com/\S+"
PRONOUNS = r"(?i)^\W*(?:pronouns?\s*:?\s*)?\(?(?:he|she|they|ze|xe)\s*/\s*(?:him|her|them|hir|zir|xem)(?:\s*/\s*\w+)?\)?\W*$"
NAME = r"^\p{L}[\p{L}'’.-]*(?:[\s'’.-]+\p{L}[\p{L}'’.-]*){0,4}$"
SCHOOL_LINE = r"(?i)\b(university|college|school|institute|academy|bachelor|master'?s|ph\.?d|b\.?\s?tech|m\.?\s?tech|b\.?sc|m\.?sc|b\.?e\b|b\.?a\b|mba|degree|gpa|cgpa|graduat|diploma|high school|secondary)\b"
FIELD = r"\bin\s+([A-Z][\w &/-]{2,60})"
INSTITUTION = r"(?i)\b(university|college|institute|school|academy|polytechnic)\b"
MEASURE = r"(?i)(\d+(?:[.,]\d+)?\s*(?:%|x|k|m|bn|\+)|[$£€]\s?\d[\d,.]*\s*[kmb]?)"
HEADINGS = r"(?i)\b(experience|employment|education|skills|projects|certifications|summary|profile|languages|awards|publications|volunteering|interests)\b"


def without_identity(text: Column) -> Column:
    """The text without its name line (its role words stay), pronoun lines and contact details."""
    bare = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, EMAIL, " "), PHONE, " "), LINK, " ")

    def head(line: Column) -> Column:
        parts = F.filter(F.transform(F.split(F.btrim(bare(F.trim(line)), F.lit(" |,·-")), r"\s+[-–—]\s+|\s*\|\s*"), F.trim), lambda p: p != "")
        named = lambda p: p.rlike(NAME) & (F.size(F.split(p, r"\s+")) <= 4) & ~p.rlike(ROLE_WORD) & ~p.rlike(WORK_HEAD) & ~p.rlike(OTHER_HEAD)
        return let(parts, lambda p: F.when((F.size(p) > 0) & named(F.coalesce(F.get(p, F.lit(0)), F.lit(""))), F.array_join(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), " - ")).otherwise(bare(line)))

    def kept(lines: Column) -> Column:
        first = lambda some: F.array_position(F.transform(some, lambda x: F.trim(x) != ""), True)
        return let(first(lines), lambda at: F.array_join(F.filter(F.transform(lines, lambda x, i: F.when(i + 1 == at, F.nullif(head(x), F.lit(""))).when(~F.trim(x).rlike(PRONOUNS), bare(x))), lambda x: x.isNotNull()), "\n"))

    return let(F.split(text, "\n"), kept)


def labelled(resumes: DataFrame) -> DataFrame:
    """id, line_no, text, heading, bullet, section of each line that isn't blank; a heading of at most five words carries on.

    section: experience, education, projects, skills, certifications, summary, other, or none ahead of the first heading.
    """
    lines = resumes.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).where("trim(raw) <> ''")
    bare = F.trim(F.btrim(F.trim("raw"), F.lit("•-*:")))
    low, short = F.lower(bare), F.size(F.split(bare, r"\s+")) <= 5
    kind = F.when(low.rlike("education|academic|qualification|coursework"), "education").when(F.contains(low, F.lit("project")), "projects").when(F.contains(low, F.lit("skill")), "skills")
    kind = kind.when(low.rlike("certif|licen|training|course"), "certifications").when(low.rlike("summary|profile|objective"), "summary").otherwise("other")
    label = F.when(short & bare.rlike(WORK_HEAD), "experience").when(short & bare.rlike(OTHER_HEAD), kind)
    carried = F.last(label, ignorenulls=True).over(Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    text = F.trim(F.regexp_replace(F.trim("raw"), BULLET, ""))
    return lines.select("id", "line_no", text.alias("text"), label.isNotNull().alias("heading"), F.trim("raw").rlike(BULLET).alias("bullet"), F.coalesce(carried, F.lit("none")).alias("section"))


def worked(resumes: DataFrame, today: str) -> DataFrame:
    """Lines of work (of all but schools, where no section is of experience) with start, end, open, precise and heading of a dated role, else null."""
    lines = labelled(resumes)
    has = F.bool_or(F.col("section") == "experience").over(Window.partitionBy("id"))
    own = (F.col("section") == "experience") | (~F.col("has") & (F.col("section") == "none") & ~F.col("text").rlike(SCHOOL_LINE))
    lines = lines.withColumn("has", has).where(own & ~F.col("heading"))
    found, dated = F.regexp_extract(F.lower("text"), RANGE, 0), F.lower("text").rlike(RANGE)
    a, b = F.regexp_extract(F.lower("text"), RANGE, 1), F.regexp_extract(F.lower("text"), RANGE, 2)
    now = F.year(F.lit(today).cast("date")) * 12 + F.month(F.lit(today).cast("date")) - 1
    still = b.rlike("^(present|current|now|today|till|to date|ongoing)")
    end = F.when(still, now).otherwise(F.least(month_index(b, F.lit(12)), now))
    at = F.position(found, F.lower("text"))
    rest = F.concat(F.substring("text", F.lit(1), at - 1), F.lit(" "), F.substring("text", at + F.length(found), F.length("text")))
    told = F.struct(month_index(a, F.lit(1)).alias("start"), end.alias("end"), still.alias("open"), (~a.rlike(r"^\d{4}$") & ~b.rlike(r"^\d{4}$")).alias("precise"), header_parts(F.btrim(rest, F.lit(" ,|-–—()"))).alias("head"))
    return lines.withColumn("d", F.when(dated, told)).withColumn("role", F.when(F.col("d.start") <= F.col("d.end"), F.col("d")))


def of_each_resume(resumes: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`work` (of id, text) on each distinct text once, whichever resumes share it."""
    told = lambda texts: work(durable(texts.select(F.col("_text").alias("id"), "text"))).withColumnRenamed("id", "_text")
    found = of_each_text(resumes.select("id", "text"), ["text"], told)
    return found.select("id", *(c for c in found.columns if c != "id"))


def roles(resumes: DataFrame, today: str) -> DataFrame:
    """`roles_in`, a resume's text once."""
    return of_each_resume(resumes, lambda texts: roles_in(texts, today))


def roles_in(resumes: DataFrame, today: str) -> DataFrame:
    """id, role (r1, ...), title, company, start, end (YYYY-MM or present), months, precision, by line."""
    order = Window.partitionBy("id").orderBy("line_no")
    rows = worked(resumes, today).where("role is not null")
    return rows.select(
        "id", F.concat(F.lit("r"), F.row_number().over(order).cast("string")).alias("role"), F.substring("role.head.title", 1, 120).alias("title"), F.substring("role.head.company", 1, 120).alias("company"),
        month_label(F.col("role.start")).alias("start"), F.when(F.col("role.open"), "present").otherwise(month_label(F.col("role.end"))).alias("end"), (F.col("role.end") - F.col("role.start") + 1).alias("months"),
        F.when(F.col("role.precise"), "month").otherwise("year").alias("precision"),
    )


def bullets(resumes: DataFrame, today: str) -> DataFrame:
    """`bullets_in`, a resume's text once."""
    return of_each_resume(resumes, lambda texts: bullets_in(texts, today))


def bullets_in(resumes: DataFrame, today: str) -> DataFrame:
    """id, bullet (b1, ...), role, text, measures: bullets, and lines of over six words, belong to the last role ahead of them."""
    order = Window.partitionBy("id").orderBy("line_no")
    rows = worked(resumes, today).withColumn("n", F.count("role").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    told = rows.where(F.col("role").isNull() & (F.col("n") > 0) & (F.col("bullet") | (F.size(F.split("text", r"\s+")) > 6)))
    name = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    return told.select("id", name("b", F.row_number().over(order)).alias("bullet"), name("r", F.col("n")).alias("role"), "text", F.slice(F.regexp_extract_all("text", F.lit(MEASURE), F.lit(1)), 1, 5).alias("measures"))


def schools(resumes: DataFrame) -> DataFrame:
    """id, text, degree, institution, start, end of each line of education, or elsewhere of a school and degree."""
    own = (F.col("section") == "education") | ((F.col("section") != "experience") & F.col("text").rlike(SCHOOL_LINE) & education_level(F.col("text")).isNotNull())
    years = F.regexp_extract_all("text", F.lit(r"\b(19[6-9]\d|20[0-4]\d)\b"), F.lit(1))
    place = F.get(F.filter(F.split("text", r",|\||–|—| - "), lambda p: p.rlike(INSTITUTION)), F.lit(0))
    return labelled(resumes).where(own & ~F.col("heading")).select(
        "id", F.substring("text", 1, 200).alias("text"), education_level(F.col("text")).alias("degree"), F.coalesce(F.trim(place), F.lit("")).alias("institution"),
        F.when(F.size(years) > 1, F.array_min(years)).otherwise("").alias("start"), F.coalesce(F.array_max(years), F.lit("")).alias("end"),
    )


def fields_of_study(resumes: DataFrame) -> DataFrame:
    """id, text, degree, field of each school: what stands behind `in` and begins with a capital, or blank."""
    return schools(resumes).select("id", "text", "degree", F.trim(F.regexp_extract("text", FIELD, 1)).alias("field"))


def projects(resumes: DataFrame) -> DataFrame:
    """id, project (p1, ...), name, bullets (array of texts, in order) of the projects section.

    A line that is no bullet begins a project, and so does a bullet ahead of any; bullets belong to the last project before them.
    """
    order = Window.partitionBy("id").orderBy("line_no")
    rows = labelled(resumes).where((F.col("section") == "projects") & ~F.col("heading"))
    named = ~F.col("bullet") | (F.row_number().over(order) == 1)
    rows = rows.withColumn("named", named).withColumn("n", F.count_if("named").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    points = F.transform(F.array_sort(F.collect_list(F.when(~F.col("named"), F.struct("line_no", "text")))), lambda x: x["text"])
    told = rows.groupBy("id", "n").agg(F.max(F.when(F.col("named"), F.substring("text", 1, 120))).alias("name"), points.alias("bullets"))
    return told.select("id", F.concat(F.lit("p"), F.col("n").cast("string")).alias("project"), "name", "bullets")


def certifications(resumes: DataFrame) -> DataFrame:
    """id, n (from 1), text: lines of the section of certificates, licences, training and courses."""
    rows = labelled(resumes).where((F.col("section") == "certifications") & ~F.col("heading"))
    return rows.select("id", F.row_number().over(Window.partitionBy("id").orderBy("line_no")).alias("n"), F.substring("text", 1, 200).alias("text"))


def skill_evidence(resumes: DataFrame, taxonomy: Taxonomy, today: str) -> DataFrame:
    """`skill_evidence_in`, a resume's text once."""
    return of_each_resume(resumes, lambda texts: skill_evidence_in(texts, taxonomy, today))


def skill_evidence_in(resumes: DataFrame, taxonomy: Taxonomy, today: str) -> DataFrame:
    """id, skill, evidence (ids of roles and bullets), months (of distinct roles), last_used, source, strength.

    source: experience, skills_list or mentioned. strength: strong with two pieces of experience, moderate with one, else weak.
    """
    named = lambda c: wanted_of(hits_in(words_of(F.col(c)), taxonomy))
    jobs = durable(roles_in(resumes, today))
    pieces = jobs.select("id", "role", F.col("role").alias("piece"), F.col("title").alias("text")).unionByName(bullets_in(resumes, today).select("id", "role", F.col("bullet").alias("piece"), "text"))
    used = durable(pieces.select("id", "role", "piece", F.explode(named("text")).alias("skill")))
    months = used.select("id", "skill", "role").distinct().join(jobs.select("id", "role", "months", "end"), ["id", "role"]).groupBy("id", "skill").agg(F.sum("months").alias("months"), F.max("end").alias("last_used"))
    found = used.groupBy("id", "skill").agg(F.array_sort(F.collect_set("piece")).alias("evidence")).join(months, ["id", "skill"])
    listed = labelled(resumes).where("section = 'skills' and not heading").select("id", F.explode(named("text")).alias("skill")).distinct().withColumn("listed", F.lit(True))
    anywhere = resumes.select("id", F.explode(named("text")).alias("skill"))
    rows = anywhere.unionByName(found.select("id", "skill")).unionByName(listed.select("id", "skill")).distinct().join(found, ["id", "skill"], "left").join(listed, ["id", "skill"], "left")
    n = F.size(F.coalesce("evidence", F.array().cast("array<string>")))
    source = F.when(n > 0, "experience").when(F.col("listed"), "skills_list").otherwise("mentioned")
    return rows.select("id", "skill", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), F.coalesce("months", F.lit(0)).alias("months"), F.coalesce("last_used", F.lit("")).alias("last_used"),
        source.alias("source"), F.when(n >= 2, "strong").when(n == 1, "moderate").otherwise("weak").alias("strength"))


def form_checks(resumes: DataFrame, today: str) -> DataFrame:
    """id and seven checks of form: extractable, headings, contact, one_column, dated, measured, length_ok."""
    heads = [F.col("text").rlike(rf"(?im)^\W*{h}").cast("int") for h in ("experience", "education", "skills")]
    doubled = F.exists(F.split("text", "\n"), lambda x: (F.size(F.regexp_extract_all(x, F.lit(HEADINGS), F.lit(1))) >= 2) & (F.size(F.split(F.trim(x), r"\s+")) <= 8))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    jobs = roles(resumes, today).groupBy("id").agg(F.bool_and(F.col("precision") == "month").alias("dated"))
    points = bullets(resumes, today).groupBy("id").agg((F.count_if(F.size("measures") > 0) / F.count("*") >= 0.3).alias("measured"))
    told = resumes.select("id", (F.length("text") >= 400).alias("extractable"), (sum(heads, F.lit(0)) == 3).alias("headings"), (F.col("text").rlike(EMAIL) | F.col("text").rlike(PHONE)).alias("contact"), (~doubled).alias("one_column"), words.between(300, 1200).alias("length_ok"))
    return told.join(jobs, "id", "left").join(points, "id", "left").fillna(False, ["dated", "measured"])


def corrected(found: DataFrame, corrections: DataFrame, now: int) -> DataFrame:
    """`found` (roles) with a person's corrections (id, role, title, company, start, end, ignore) on top, and months anew; `now` is the month's index."""
    new = corrections.select("id", "role", *(F.nullif(F.col(c), F.lit("")).alias(f"_{c}") for c in ("title", "company", "start", "end")), F.coalesce("ignore", F.lit(False)).alias("_ignore"))
    rows = found.join(new, ["id", "role"], "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("title", "company", "start", "end")})
    again = months_between(F.col("start"), F.col("end"), F.lit(now))
    return rows.withColumns({"ignore": F.coalesce("_ignore", F.lit(False)), "months": F.when(again > 0, again).otherwise(F.col("months"))}).select(*found.columns, "ignore")


def corrected_months(found: DataFrame) -> DataFrame:
    """id, months: length of the union of the roles (of `corrected`) that aren't ignored."""
    start = F.substring("start", 1, 4).try_cast("int") * 12 + F.substring("start", 6, 2).try_cast("int") - 1
    spans = found.where(~F.col("ignore") & (F.col("months") > 0)).select("id", start.alias("start"), (start + F.col("months") - 1).alias("end")).where("start is not null")
    return merged_months(spans, "id")
