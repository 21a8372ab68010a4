"""Postings and cases that aren't fetched: typed in, samples, cards with their details, and files of cases, a JSON object a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import relevance
from ..operators.funnel import Query, drop_reason, tagged
from ..operators.ordering import ranked
from ..operators.records import one_each

FEW = 4  #: samples that a title must have to be shown alone
PROBLEM = "_problem"


def manual(rows: DataFrame) -> DataFrame:
    """Postings of typed rows (pos, title, company, location, url, description): trimmed, id manual-<place by pos, from 1>, source manual.

    Null cells are empty; rows of one pos stand as they come; an empty table stays empty.
    """
    plain = lambda c: F.trim(F.coalesce(c, F.lit(""))).alias(c)
    placed = ranked(rows.select("pos", *(plain(c) for c in ("title", "company", "location", "url", "description"))), [F.col("pos")])
    return placed.select(F.concat(F.lit("manual-"), F.col("place").cast("string")).alias("id"), F.lit("manual").alias("source"), "title", "company", "location", "url", "description")


def samples(postings: DataFrame, title: str) -> DataFrame:
    """`postings` with relevance and place: those that fit the title by half, the best first, or all of them where fewer than FEW do; ties by id."""
    context = F.concat_ws(" ", F.col("tags") if "tags" in postings.columns else F.lit(""), F.substring("description", 1, 800))
    rows = postings.withColumn("relevance", F.coalesce(relevance(F.col("title"), context, F.lit(title)), F.lit(0.0)))
    fit = rows.where(F.col("relevance") >= 0.5)
    picked = fit if fit.limit(FEW).count() == FEW else rows
    return ranked(picked, [F.desc("relevance"), F.col("id")])


def carded(cards: DataFrame, details: DataFrame, query: Query) -> DataFrame:
    """Postings of a search's cards that pass the filters with what the card says, and again with the details of their page.

    A card tells title, company, place and date; a detail (id, description, employment_type, seniority) the rest. So pages
    are only needed for cards that pass. Cards without a page keep what they have. Of repeated ids one counts.
    """
    known = [c for c in ("description", "employment_type", "seniority") if c in details.columns]
    empty = {c: F.lit("") for c in ("description", "employment_type", "seniority") if c not in cards.columns}
    rows = one_each(cards, "id").withColumns({**empty, "source": F.lit("linkedin")})
    first = tagged(rows, query).where("drop is null").drop("drop")
    more = one_each(details, "id").select("id", *(F.nullif(F.col(c), F.lit("")).alias(f"_{c}") for c in known))
    joined = first.join(more, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in known}).drop(*(f"_{c}" for c in known))
    return joined.withColumn("_why", drop_reason(query)).where("_why is null").drop("_why")


def read_cases(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The cases of a file or folder, a JSON object a line, and the lines that are none (file, line). Blank lines are neither."""
    rows = spark.read.schema(f"{schema}, {PROBLEM} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", PROBLEM).json(path)
    rows = rows.withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    lines = spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("line")).where("trim(line) <> ''")
    broken = lines.where(F.from_json("line", f"{schema}, {PROBLEM} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": PROBLEM})[PROBLEM].isNotNull())
    return rows.where(F.col(PROBLEM).isNull()).drop(PROBLEM, "_file"), broken
