"""A derived relation of postings over the driver's tables, in SQL that Spark and DuckDB read alike, and one profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "1998-12-01 00:00:00"
TABLES = ("orders", "lineitem", "part", "supplier", "customer", "nation")

POSTINGS = """
select concat('p-', cast(o_orderkey as varchar(20))) as id,
    case cast(o_orderkey % 5 as int) when 0 then 'greenhouse' when 1 then 'lever' when 2 then 'linkedin' when 3 then 'adzuna' else 'remotive' end as source,
    concat('Acme ', cast(s_suppkey % 20 as varchar(20)), case cast(s_suppkey % 4 as int) when 0 then ' Inc.' when 1 then ' GmbH' when 2 then ' Ltd' else '' end) as company,
    concat(case cast(o_orderkey % 6 as int) when 0 then '' when 1 then 'Senior ' when 2 then 'Junior ' when 3 then 'Lead ' when 4 then 'Staff ' else 'Sr. ' end,
        case cast(l_partkey % 8 as int) when 0 then 'Data Engineer' when 1 then 'Backend Developer' when 2 then 'Data Analyst' when 3 then 'Engineering Manager'
            when 4 then 'Front End Developer' when 5 then 'ML Engineer' when 6 then 'Nurse Practitioner' else 'Data Engineer, Platform' end) as title,
    case cast(o_custkey % 9 as int) when 0 then 'Berlin, Germany' when 1 then 'London, UK' when 2 then 'Remote' when 3 then 'Remote - Europe' when 4 then 'New York, NY'
        when 5 then 'Bangalore, India' when 6 then 'Brussels, Belgium' when 7 then '' else 'Remote (US)' end as location,
    case cast(o_orderkey % 7 as int) when 0 then true when 1 then false else null end as remote,
    case when o_orderkey % 11 = 0 then null else o_orderdate end as posted,
    case cast(o_orderkey % 5 as int) when 0 then 'Full-time' when 1 then 'Permanent' when 2 then 'Contract' when 3 then 'Internship' else '' end as employment_type,
    case cast(l_suppkey % 5 as int) when 0 then '$120k - $150k' when 1 then '£60,000 per year' when 2 then '$55/hour' when 3 then '€4,500 - €5,500 per month' else '' end as salary,
    concat('About the role', chr(10), 'We ship ', lower(p_type), ' parts for ', lower(c_mktsegment), ' customers in ', n_name, '.', chr(10), 'Requirements', chr(10),
        '• ', cast(2 + p_size % 7 as varchar(20)), '+ years of experience with Python', chr(10), '• SQL and Airflow', chr(10),
        case cast(p_size % 4 as int) when 0 then '• Apache Spark pipelines' when 1 then '• Kafka or Kinesis' when 2 then '• No Java required' else '• Degree in computer science' end, chr(10),
        case cast(l_partkey % 6 as int) when 0 then '• Node.js and CI/CD' when 1 then '• Identity and access management' when 2 then '• Java is not required' when 3 then '• Strong communication and teamwork'
            when 4 then '• Ruby with Rails; spring 2024 intake' else '• Ability to explain steel parts to customers' end, chr(10),
        'Nice to have', chr(10), '• Docker', chr(10), p_name, case when o_orderkey % 3 = 0 then concat(' ', p_name, ' ', p_brand, ' ', c_name) else '' end) as description
from orders join (select l_orderkey, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey from lineitem where l_linenumber = 1 group by l_orderkey) first_line
    on l_orderkey = o_orderkey join part on p_partkey = l_partkey
    join supplier on s_suppkey = l_suppkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey"""

def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation, without touching the session's catalog."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    text = POSTINGS
    for t in tables:
        text = text.replace(f" {t} ", f" {{{t}}} ").replace(f"join {t} ", f"join {{{t}}} ")
    return spark.sql(text, **tables)
