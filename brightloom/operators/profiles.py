"""Work experience in resumes: lines, the section each is in, dated ranges, and the months that they cover together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import merged_months
from .requirements import education_level  # noqa: F401 (one rule of degrees; callers find it here too)

# --- fixed values: headings, months ---------------------------------------------------------------------------
WORK = r"^(professional |work |relevant )?(experience|employment|work history|career history)( history)?$"
OTHER = r"^(education|skills|technical skills|projects|certifications|publications|awards|languages|interests|summary|volunteering|courses)$"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
SCHOOL = r"\b(university|college|school|bachelor|master'?s|ph\.?d|degree|gpa|diploma)\b"
DAY = rf"(?:(?:{'|'.join(MONTHS)})[a-z]*\.? ?'?(?:\d{{4}}|\d{{2}}(?!\d))|\d{{1,2}}[/.]\d{{4}}|\d{{4}}-\d{{2}}|\d{{4}})"
RANGE = rf"\b({DAY})\s*(?:-|–|—|to|until|till)\s*({DAY}|present|current(?:ly)?|now|today|till date|to date|ongoing)\b"
CLAIM = r"(\d{1,2})\+? ?(?:years?|yrs?)\b[^.\n]{0,60}experience|experience[^.\n]{0,60}?(\d{1,2})\+? ?(?:years?|yrs?)\b"
LONGEST = 40 * 12  #: months beyond which a range is taken for an error


def month_index(text: Column, last: Column) -> Column:
    """year * 12 + month - 1 of a date; `last` is the month that a bare year stands for."""
    named = F.regexp_extract(text, rf"^({'|'.join(MONTHS)})[a-z]*\.? ?'?(\d{{4}}|\d{{2}})$", 1)
    number = F.array_position(F.array(*map(F.lit, MONTHS)), named)
    short = F.regexp_extract(text, r"(?<!\d)(\d{2})$", 1).try_cast("int") + 2000  # as in Jan '24
    year = F.coalesce(F.regexp_extract(text, r"(\d{4})", 1).try_cast("int"), short)
    month = F.coalesce(F.regexp_extract(text, r"^(\d{1,2})[/.]", 1).try_cast("int"), F.regexp_extract(text, r"^\d{4}-(\d{2})$", 1).try_cast("int"))
    return (year * 12 + F.when(number > 0, number).otherwise(F.coalesce(month, last)) - 1).cast("int")


def sections(resumes: DataFrame) -> DataFrame:
    """id, line_no, line, section (work, other, none): a heading of at most five words carries on to the next."""
    lines = resumes.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    bare = F.btrim(F.lower("line"), F.lit(" •-*:"))
    label = F.when(F.size(F.split(bare, " ")) <= 5, F.when(bare.rlike(WORK), "work").when(bare.rlike(OTHER), "other"))
    carried = F.last(label, ignorenulls=True).over(Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("section", F.coalesce(carried, F.lit("none")))


def spans(resumes: DataFrame, today: str) -> DataFrame:
    """id, line_no, start, end, precise: each dated range; of the work section, or without one, of lines that aren't of schools."""
    lines = sections(resumes)
    work = F.bool_or(F.col("section") == "work").over(Window.partitionBy("id"))
    own = F.when(F.col("work"), F.col("section") == "work").otherwise((F.col("section") != "other") & ~F.lower("line").rlike(SCHOOL))
    dated = lines.withColumn("work", work).where(own).select("id", "line_no", F.explode(F.regexp_extract_all(F.lower("line"), F.lit(RANGE), F.lit(0))).alias("r"))
    a, b = F.regexp_extract("r", RANGE, 1), F.regexp_extract("r", RANGE, 2)
    now = F.year(F.lit(today).cast("date")) * 12 + F.month(F.lit(today).cast("date")) - 1
    open_end = b.rlike("^(present|current|now|today|till|to date|ongoing)")
    end = F.when(open_end, now).otherwise(F.least(month_index(b, F.lit(12)), now))
    rows = dated.select("id", "line_no", month_index(a, F.lit(1)).alias("start"), end.alias("end"), (~a.rlike(r"^\d{4}$") & ~b.rlike(r"^\d{4}$")).alias("precise"))
    return rows.where((F.col("start") >= 1970 * 12) & (F.col("end") >= F.col("start")) & (F.col("end") - F.col("start") <= LONGEST))


def experience(resumes: DataFrame, today: str) -> DataFrame:
    """id, months, explicit_years, years, precision (month, year, none) of each resume (id, text). Ids are unique."""
    dated = spans(resumes, today)
    sums = merged_months(dated, "id").join(dated.groupBy("id").agg(F.bool_and("precise").alias("precise")), "id")
    said = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(CLAIM), F.lit(0)), lambda s: F.regexp_extract(s, r"(\d{1,2})\+? ?(?:years?|yrs?)\b", 1).try_cast("int"))
    claimed = F.coalesce(F.array_max(F.filter(said, lambda n: n <= 40)), F.lit(0))
    rows = resumes.select("id", claimed.alias("explicit_years")).join(sums, "id", "left")
    months = F.coalesce("months", F.lit(0)).cast("long")
    precision = F.when(F.col("precise"), "month").when(F.col("precise").isNotNull(), "year").otherwise("none")
    return rows.select("id", months.alias("months"), "explicit_years", F.bround(F.greatest(months / 12, F.col("explicit_years").cast("double")), 2).alias("years"), precision.alias("precision"))
