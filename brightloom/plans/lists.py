"""Registered queries on tables and lists, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import requirements as Q
from ..operators import tables as L
from .postings import postings
from .queries import P, query, table
from .scoring import SQL_YEARS

_RESULTS = "select o_orderkey as id, o_custkey as analysis, o_orderpriority as title, cast(floor(o_totalprice) as bigint) % 101 as score, o_orderstatus = 'F' as verified from orders"


def results(spark, sf_dir):
    return spark.sql(_RESULTS.replace("from orders", "from {o}"), o=table(spark, sf_dir, "orders"))


@query(f"with {P} select id from p where source in ('lever', 'adzuna') and employment_type in ('Contract', 'Permanent') and contains(lower(concat_ws(' ', title, company, location)), 'data')")
def faceted_rows(spark, sf_dir):
    p = postings(spark, sf_dir)
    return L.faceted(p, {"source": ["lever", "adzuna"], "employment_type": ["Contract", "Permanent"]}, "Data", ["title", "company", "location"]).select("id")


@query(f"with {P} select id, length(description) as description_chars from p where contains(lower(title || ' ' || company), 'engineer') and not contains(lower(title), 'senior') and not contains(lower(title), 'lead') and source in ('lever', 'remotive')")
def prefiltered_rows(spark, sf_dir):
    return L.listed(L.prefiltered(postings(spark, sf_dir), "Engineer", "senior, lead", ["lever", "remotive"])).select("id", F.col("description_chars").cast("long").alias("description_chars"))


@query(f"with {P} select id, row_number() over (order by lower(title), coalesce(epoch(posted), 0) desc, id) as place from p")
def table_order(spark, sf_dir):
    return L.placed(postings(spark, sf_dir), F.lower("title"), F.coalesce(F.unix_seconds(F.col("posted").cast("timestamp")), F.lit(0)).desc()).select("id", "place")


@query("select l_orderkey, l_linenumber, l_quantity from (select *, max(l_quantity) over (partition by l_orderkey) as m from lineitem) where l_quantity = m")
def best_in_row(spark, sf_dir):
    return L.best_in_row(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity")


@query(f"with r as ({_RESULTS}) select analysis, count(*) as jobs, max(score) as top_score, first(title order by score desc, title) as top_title, count(*) filter (verified) as verified from r group by analysis")
def analysis_headlines(spark, sf_dir):
    return L.headlines(results(spark, sf_dir), "analysis")


@query(f"with r as ({_RESULTS}) select id from r where not verified order by score >= 60 desc, score desc, id limit 25")
def deep_targets(spark, sf_dir):
    return L.deep_targets(results(spark, sf_dir), 60, 25)


@query(f"""with r as ({_RESULTS}), p as (select o_orderkey * 2 as job_id, greatest(1, least(3, o_custkey % 6)) as priority from orders), j as (select p.job_id, priority, score is not null as known, score from p left join r on r.id = p.job_id)
    select job_id, priority, known, case when known then row_number() over (partition by known order by priority, score desc, job_id) end as place from j""")
def strategy_picks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    picks = o.select((F.col("o_orderkey") * 2).alias("job_id"), (F.col("o_custkey") % 6).alias("priority"))
    return L.checked_picks(picks, results(spark, sf_dir).select(F.col("id").alias("job_id"), "score"))


@query(f"""with {P}, n as (select id, source as occupation, row_number() over (partition by source order by id) as n, row_number() over (partition by source order by md5('s' || id), id) as m from p),
    r(resume, occupation) as (values (1, 'lever'), (2, 'adzuna')), d as (select resume, id, row_number() over (partition by resume order by md5('s' || resume || id), id) as k from r join n on r.occupation <> n.occupation where m <= 6)
    select resume, id, true as own from r join n using (occupation) where n <= 3 union all select resume, id, false from d where k <= 6""")
def label_pairs(spark, sf_dir):
    resumes = spark.createDataFrame([(1, "lever"), (2, "adzuna")], "resume int, occupation string")
    return L.label_pairs(resumes, postings(spark, sf_dir).select("id", F.col("source").alias("occupation")), 9, "s")


@query(f"with {P}, {SQL_YEARS} select cast(coalesce(stated, senior) as double) as years, count(*) as n from years where coalesce(stated, senior) is not null group by 1")
def years_asked(spark, sf_dir):
    return L.years_asked(postings(spark, sf_dir).select(Q.required_years(F.col("title"), F.col("description"))["years"].alias("years")))


@query(f"with {P}, {SQL_YEARS} select median(cast(coalesce(stated, senior) as double)) as median from years")
def median_years(spark, sf_dir):
    return L.median_of_counts(years_asked(spark, sf_dir), "years", "n")


@query(f"with {P} select round(100.0 * count(*) filter (coalesce(remote, contains(lower(location), 'remote'))) / count(*), 6) as remote_pct, count(distinct company) as companies from p")
def market_shares(spark, sf_dir):
    from ..functions.text import is_remote

    return postings(spark, sf_dir).agg(F.round(100.0 * F.count_if(is_remote(F.col("remote"), F.col("location"))) / F.count("*"), 6).alias("remote_pct"), F.count_distinct("company").alias("companies"))


@query("select c_custkey, n_name from customer join nation on n_nationkey = c_nationkey where c_acctbal > 0")
def sessions_of_users(spark, sf_dir):
    """Sessions (customers) joined to their users (nations), live ones alone."""
    live = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return live.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_name")
