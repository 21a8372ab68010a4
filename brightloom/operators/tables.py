"""What tables and lists show: filters by facets, orders with unknown last, the best of a row, headlines, targets, picks, pairs to label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from .ordering import ranked


def faceted(rows: DataFrame, chosen: dict[str, list[str]], sought: str, columns: list[str]) -> DataFrame:
    """Rows that have one of the chosen values of every facet, and the sought letters somewhere in the columns."""
    for column, values in chosen.items():
        if values:
            rows = rows.where(F.col(column).isin(*values))
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(sought.lower()))) if sought else rows


def prefiltered(postings: DataFrame, include: str, excluded: str, sources: list[str]) -> DataFrame:
    """Postings whose title or company holds `include`, whose title holds none of a comma list, of the sources (all if none is named)."""
    rows = postings.where(F.contains(F.lower(F.concat_ws(" ", "title", "company")), F.lit(include.lower())))
    for word in (w.strip().lower() for w in excluded.split(",")):
        rows = rows.where(~F.contains(F.lower("title"), F.lit(word))) if word else rows
    return rows.where(F.col("source").isin(*sources)) if sources else rows


def listed(postings: DataFrame) -> DataFrame:
    """Postings as lists show them: the description's length instead of the description."""
    return postings.withColumn("description_chars", F.length("description")).drop("description")


def placed(rows: DataFrame, *orders: Column) -> DataFrame:
    """`rows` (id) with their place from 1 in an order; ties by id. The whole table is ordered, range by range."""
    return ranked(rows, [*orders, F.col("id")])


#: How tables order a column: text without case, unknown dates last, statuses by what they mean, other numbers with null least.
STATUS_RANK = {"qualified": 0, "gate": 1, "near": 2, "below": 3}


def table_orders(column: str, kind: str, descending: bool = False) -> Column:
    """The order of a table by one of its columns of kind text, number, date or status; unknown values come last either way."""
    told = F.col(column)
    if kind == "text":
        told = F.nullif(F.lower(told), F.lit(""))
    elif kind == "date":
        told = F.unix_seconds(told.cast("timestamp"))
    elif kind == "status":
        told = F.try_element_at(F.create_map(*(F.lit(x) for pair in STATUS_RANK.items() for x in pair)), told)
    return told.desc_nulls_last() if descending else told.asc_nulls_last()


def best_in_row(rows: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """The rows of each key that share its largest value, nulls aside."""
    most = rows.groupBy(key).agg(F.max(value).alias("_most"))
    return rows.join(most, key).where(F.col(value) == F.col("_most")).select(key, name, value)


def headlines(results: DataFrame, group: str) -> DataFrame:
    """group, jobs, top_score, top_title, verified of scored results; of equal scores the first title by name."""
    top = F.min_by("title", F.struct(-F.col("score"), F.col("title")))
    return results.groupBy(group).agg(F.count("*").alias("jobs"), F.max("score").alias("top_score"), top.alias("top_title"), F.count_if("verified").alias("verified"))


def deep_targets(results: DataFrame, threshold: int, most: int) -> DataFrame:
    """id of what is checked next: not yet verified, qualifying ones first, then by score."""
    return results.where(~F.col("verified")).orderBy((F.col("score") >= threshold).desc(), F.desc("score"), "id").limit(most).select("id")


def checked_picks(picks: DataFrame, facts: DataFrame) -> DataFrame:
    """job_id, priority, known, place: picks against the facts they may rest on; unknown jobs are told, known ones ordered by priority and score.

    Picks may be any number: known ones are ordered range by range. Facts are one a job; of several the best score counts.
    """
    best = facts.groupBy("job_id").agg(F.max("score").alias("score"))
    rows = picks.join(best, "job_id", "left").withColumn("priority", F.greatest(F.lit(1), F.least(F.lit(3), F.col("priority"))))
    rows = rows.withColumn("known", F.col("score").isNotNull())
    known = ranked(rows.where("known"), [F.col("priority"), F.desc("score"), F.col("job_id")])
    unknown = rows.where(~F.col("known")).withColumn("place", F.lit(None).cast("long"))
    out = ["job_id", "priority", "known", "place"]
    return known.select(out).unionByName(unknown.select(out))


def first_of_each(rows: DataFrame, group: str, order: list[Column], most: int, n: str) -> DataFrame:
    """The `most` first rows of each group with their number; tasks keep as many of a group before they shuffle, so a hot group is cut at once."""
    return rows.withColumn(n, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(n) <= most)


def label_pairs(resumes: DataFrame, postings: DataFrame, most: int, seed: str) -> DataFrame:
    """resume, id, own: for each resume a third of `most` postings of its occupation, the first by id, and a hashed sample of others.

    Only the first few postings of each occupation go on, so no resume meets all; those of other occupations are gathered
    for each occupation, of which there are few, and joined to resumes by equality.
    """
    head, rest = max(1, most // 3), most - max(1, most // 3)
    told = postings.select("id", "occupation")
    heads = first_of_each(told, "occupation", [F.col("id")], head, "n")
    pool = durable(first_of_each(told, "occupation", [F.md5(F.concat(F.lit(seed), "id")), F.col("id")], rest, "m"))
    own = resumes.join(heads, "occupation").select("resume", "id", F.lit(True).alias("own"))
    kinds = resumes.select("occupation").distinct().alias("k")
    others = kinds.join(pool.alias("p"), F.col("k.occupation") != F.col("p.occupation")).select("k.occupation", "p.id")  # occupations times `rest` for each
    met = resumes.join(others, "occupation").withColumn("h", F.md5(F.concat(F.lit(seed), F.col("resume").cast("string"), "id")))
    drawn = first_of_each(met, "resume", [F.col("h"), F.col("id")], rest, "k")
    return own.unionByName(drawn.select("resume", "id", F.lit(False).alias("own")))


def years_asked(years: DataFrame) -> DataFrame:
    """years, n: how many postings ask for each number of years."""
    return years.where("years is not null").groupBy("years").agg(F.count("*").alias("n"))


def recency(hours: Column) -> Column:
    """A posting's age in the table's steps: a day, a week, a month of 31 days, older, or unknown."""
    days = hours / 24
    return F.when(days.isNull(), "date unknown").when(days <= 1, "≤ 1 day").when(days <= 7, "≤ 1 week").when(days <= 31, "≤ 1 month").otherwise("older")


def median_of_counts(counts: DataFrame, value: str, n: str) -> DataFrame:
    """One row: the median of values given with how often each occurs."""
    from .ordering import at_places

    both = at_places(counts.withColumn("_all", F.lit(1)), ["_all"], value, n, {"low": lambda t: F.floor((t - 1) / 2), "high": lambda t: F.floor(t / 2)})
    return both.select(((F.col("low") + F.col("high")) / 2).alias("median"))
