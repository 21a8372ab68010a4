"""Registered queries on gates, resumes, claims, deletes and fitted curves, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import evaluation as E
from ..operators import gates as G
from ..operators import profiles as R
from ..operators import records
from ..operators import resumes as B
from .postings import POSTINGS, postings
from .queries import JUDGED, judged, query, table
from .scoring import SQL_SCORES, TAX, all_scores

#: Sentences that the derived postings get in turn, so that there are gates to find.
NOTICES = [
    "Must be authorized to work in the United States.", "Only UK citizens; DV clearance needed.", "The company doesn't offer sponsorship; we do not offer visa sponsorship.", "Fluent in German. French is required.",
    "German is a plus; fluent in Dutch is preferred.", "CPA; fully onsite.", "Security clearance is a plus.\nYou must be based in Berlin.", "Eligible to work in Germany; no visa sponsorship.",
]
PERSON = G.Eligibility(countries=("US",), needs_sponsorship=True, languages=("German",))
NOTICE = f"([{', '.join('\'' + n.replace('\'', '\'\'') + '\'' for n in NOTICES)}])[1 + cast(substr(id, 3) as bigint) % {len(NOTICES)}]"
RESUME = "concat('Jane Doe', chr(10), 'Experience', chr(10), 'Engineer ', cast(1 + c_custkey % 12 as varchar(9)), '/', cast(2005 + c_nationkey % 9 as varchar(9)), ' - ', cast(2009 + c_nationkey % 13 as varchar(9)), chr(10), 'Analyst 2003 - 2004', chr(10), 'Education', chr(10), 'School 1990 - 2003')"
CLAIM = "o_orderkey as id, concat('Senior engineer cut cost by ', cast(o_orderkey % 7 as varchar(9)), '% in ', cast(1994 + o_orderkey % 3 as varchar(9))) as new, concat('Cut cost by ', cast(o_custkey % 7 as varchar(9)), '% in ', cast(1994 + o_custkey % 3 as varchar(9))) as source"


def noticed(spark, sf_dir):
    turn = F.pmod(F.expr("cast(substr(id, 3) as bigint)"), F.lit(len(NOTICES))).cast("int")
    notice = F.element_at(F.array(*map(F.lit, NOTICES)), turn + 1)
    return postings(spark, sf_dir).select("id", F.concat("description", F.lit("\n"), notice).alias("description"))


_CLAUSE = r"substr(trim(regexp_replace(regexp_replace(substr(text, 1, strpos(text, m) - 1), '(?s)^.*(\n|\. |; )', '') || m || regexp_split_to_array(substr(text, strpos(text, m) + length(m)), '\n|\. |; ')[1], '\s+', ' ', 'g'), ' -•*;.'), 1, 220)"
_TONGUES = "English|German|French|Spanish|Italian|Portuguese|Dutch|Polish|Swedish|Danish|Norwegian|Finnish|Japanese|Mandarin|Chinese|Cantonese|Korean|Arabic|Hebrew|Hindi|Russian|Turkish|Greek|Czech"
_SPOKEN = rf"(?i)\b(?:fluent|fluency|native|proficient|proficiency|business[- ]level|professional)\s+(?:in\s+)?(?:(?:written|spoken|and|or|both|level|working)\s+)*({_TONGUES})\b|\b({_TONGUES})\s+(?:is\s+)?(?:required|essential|mandatory|a must)\b|\b({_TONGUES})[- ]speaking\b"


def sql_gates() -> str:
    """Each kind of gate by itself: the first match, its clause, and whether the clause softens it."""
    first = lambda pattern: rf"nullif(regexp_extract(text, '(?i){pattern}', 0), '') as m"
    work = r"\b(?:legally\s+)?(?:authori[sz]ed|eligible|entitled|right)\s+to\s+work\s+in\s+(?:the\s+)?(US|U\.S\.|USA|United States|UK|U\.K\.|United Kingdom|EU|European Union|Canada|Australia|Germany|India|Ireland|Netherlands|France|Singapore|New Zealand)\b"
    citizen = r"\b(?:must be|only)\s+(?:a\s+)?(US|U\.S\.|UK|British|Canadian|Australian)\s+citizens?\b"
    refused = r"\b(?:no|not|unable to|cannot|can''t|will not|won''t|do not|does not|don''t)\s+(?:offer\s+|provide\s+)?(?:visa\s+)?sponsor(?:ship)?\b|\bwithout\s+(?:the\s+need\s+for\s+)?(?:visa\s+)?sponsorship\b|\bsponsorship\s+(?:is\s+)?not\s+(?:available|offered|provided)\b"
    clearance = r"\b(?:TS/SCI|top secret|secret|SC|DV|NV1|NV2|baseline|public trust)\s+(?:security\s+)?clearance\b|\bsecurity clearance\b|\bclearance\s+(?:is\s+)?required\b"
    onsite = r"\b(?:on-?site|in[- ]office|in the office)\b[^.\n]{0,40}\b(?:\d\s*days|full[- ]time|required|only|5 days|every day)\b|\bfully on-?site\b|\b(?:must|required to)\s+(?:be\s+)?(?:located|based|live)\s+(?:in|within|near)\b|\bno remote\b"
    name = lambda pattern: rf"case lower(regexp_extract(m, '(?i){pattern}', 1)) when 'united states' then 'US' when 'us' then 'US' when 'uk' then 'UK' when 'germany' then 'Germany' end"
    return rf"""p as ({POSTINGS}), d as (select id, description || chr(10) || {NOTICE} as text from p), r as (select id, regexp_matches(text, '(?i){refused}') as refused from d),
        works as (select id, text, {first(work)} from d), citizens as (select id, text, {first(citizen)} from d where not regexp_matches(text, '(?i){work}')),
        refusals as (select id, text, {first(refused)} from d where not regexp_matches(text, '(?i){work}') and not regexp_matches(text, '(?i){citizen}')),
        spoken as (select id, text, unnest(list_distinct(regexp_extract_all(text, '{_SPOKEN}', 0))) as m from d),
        tongues as (select id, {_CLAUSE} as told, coalesce(nullif(regexp_extract(m, '{_SPOKEN}', 1), ''), nullif(regexp_extract(m, '{_SPOKEN}', 2), ''), regexp_extract(m, '{_SPOKEN}', 3)) as need, strpos(text, m) as place from spoken),
        found as (
            select id, 'authorization' as type, {name(work)} as need, {_CLAUSE} as text, refused as no_sponsorship from works join r using (id) where m is not null
            union all select id, 'authorization', {name(citizen)}, {_CLAUSE}, true from citizens where m is not null
            union all select id, 'authorization', '', {_CLAUSE}, true from refusals where m is not null
            union all select id, 'clearance', case when regexp_matches(m, '(?i)^security|^clearance') then 'Security' when lower(m) = 'dv clearance' then 'DV' else 'SECRET' end, {_CLAUSE}, false from (select id, text, {first(clearance)} from d) where m is not null
            union all select id, 'license', 'CPA / chartered accountant', {_CLAUSE}, false from (select id, text, {first(chr(92) + 'bcpa' + chr(92) + 'b')} from d) where m is not null
            union all select id, 'language', need, told, false from tongues where not regexp_matches(told, '(?i)\b(a plus|nice to have|preferred|bonus|advantage|desirable|ideally)\b') qualify row_number() over (partition by id, need order by place) = 1
            union all select id, 'onsite', '', {_CLAUSE}, false from (select id, text, {first(onsite)} from d) where m is not null),
        gates as (select * from found where not (type in ('clearance', 'license') and regexp_matches(text, '(?i)\b(a plus|nice to have|preferred|bonus|advantage|desirable|ideally)\b'))),
        settled as (select *, case type when 'authorization' then case when need = 'US' then 'pass' else 'fail' end when 'clearance' then 'fail' when 'license' then 'fail'
            when 'language' then case when need in ('German', 'English') then 'pass' else 'fail' end else 'unknown' end as status from gates)"""


@query(f"with {sql_gates()} select * from gates")
def stated_gates(spark, sf_dir):
    return G.stated(noticed(spark, sf_dir))


@query(f"with {sql_gates()} select type, status, count(*) as n from settled group by all")
def gate_statuses(spark, sf_dir):
    return G.settled(G.stated(noticed(spark, sf_dir)), PERSON).groupBy("type", "status").agg(F.count("*").alias("n"))


@query(f"""with {SQL_SCORES}, {sql_gates().replace(f"p as ({POSTINGS}), ", "", 1)} select type, count(distinct id) as jobs from settled join (select id as scored, score from scores) s on scored = id where status = 'fail' and score >= 60 group by type""")
def gates_held_back(spark, sf_dir):
    gates = G.settled(G.stated(noticed(spark, sf_dir)), PERSON)
    return G.held_back(all_scores(spark, sf_dir), gates, 60)


@query("""with m as (select c_custkey as id, (2005 + c_nationkey % 9) * 12 + c_custkey % 12 as s, (2009 + c_nationkey % 13) * 12 + 11 as e from customer),
    t as (select id, s, e, e >= s and e - s <= 480 as ok from m) select id, cast(24 + case when ok then e - s + 1 else 0 end as bigint) as months, 0 as explicit_years,
    round_even((24 + case when ok then e - s + 1 else 0 end) / 12, 2) as years, 'year' as precision from t""")
def resume_experience(spark, sf_dir):
    resumes = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", f"{RESUME} as text")
    return R.experience(resumes, "2024-05-01")


@query("""with c as (select o_orderkey as id, o_orderkey % 7 as a, o_custkey % 7 as b, 1994 + o_orderkey % 3 as y, 1994 + o_custkey % 3 as z from orders)
    select id, concat_ws(',', case when a <> b then 'number ' || a || '%' end, case when y <> z then 'year ' || y end, 'title senior') as found from c""")
def claim_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(*CLAIM.replace(", concat('S", "|concat('S").replace(", concat('Cut", "|concat('Cut").split("|"))
    found = C.violations(F.col("new"), F.col("source"), F.lit(""))
    return rows.select("id", F.array_join(F.transform(found, lambda v: F.concat_ws(" ", v.kind, v.value)), ",").alias("found"))


@query("""with c as (select * from customer where c_custkey % 10 <> 0), o as (select * from orders where o_custkey % 10 <> 0 or o_custkey not in (select c_custkey from customer)), l as (select * from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey not in (select o_orderkey from o)))
    select 'customer' as name, count(*) as n from c union all select 'orders', count(*) from o union all select 'lineitem', count(*) from l""")
def cascade_delete(spark, sf_dir):
    tables = {t: table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem")}
    gone = tables["customer"].where("c_custkey % 10 = 0").select("c_custkey")
    left = records.cascaded(tables, "customer", gone, [("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")])
    counts = [rows.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, rows in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("select 'events' as name, count(*) filter (ts <= timestamp '2024-01-15') as expired from events union all select 'orders', count(*) filter (o_orderdate <= timestamp '2024-01-15') from orders")
def purge_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("ts").alias("expires_at"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("expires_at"))
    return records.purged({"events": events, "orders": orders}, "2024-01-15")


@query(f"""with j as ({JUDGED}), c as (select v, 2.0 * count(*) filter (quality = v and toxic = v) / (count(*) filter (quality = v) + count(*) filter (toxic = v)) as f1 from j, (values (0), (1)) as t(v) group by v having count(*) filter (quality = v or toxic = v) > 0) select count(*) as classes, round(avg(f1), 9) as macro_f1 from c""")
def macro_f1(spark, sf_dir):
    return E.macro_f1(judged(spark, sf_dir), "quality", "toxic").select("classes", F.round("macro_f1", 9).alias("macro_f1"))


@query()
def calibration_curve(spark, sf_dir):
    a, b = E.logistic(judged(spark, sf_dir), "confidence", F.col("quality") == 1)
    return spark.createDataFrame([(a, b)], "intercept double, slope double")


# --- resumes in parts ------------------------------------------------------------------------------------------------------

PERSON_TEXT = """concat('Jane Doe | Data Engineer', chr(10), 'she/her', chr(10), 'jane@example.org', chr(10), 'Experience', chr(10), 'Engineer at Acme ', cast(1 + c_custkey % 12 as varchar(9)), '/', cast(2005 + c_nationkey % 9 as varchar(9)), ' - ',
    case when c_custkey % 3 = 0 then 'present' else cast(2014 + c_nationkey % 3 as varchar(9)) end, chr(10), '• Built Python pipelines, 20% faster', chr(10), '• SQL and Airflow', chr(10), 'Beta Ltd, Analyst 2003 - 2004', chr(10), '• Moved to Python', chr(10),
    'Education', chr(10), 'MSc in Physics, Rome University, 1998 - 2003', chr(10), 'Skills', chr(10), 'Docker, Kafka')"""
_START = "(2005 + c_nationkey % 9) * 12 + c_custkey % 12"
_END = "case when c_custkey % 3 = 0 then 2024 * 12 + 4 else (2014 + c_nationkey % 3) * 12 + 11 end"
_LABEL = "cast({0} // 12 as varchar) || '-' || lpad(cast({0} % 12 + 1 as varchar), 2, '0')"
SQL_ROLES = f"""jobs as (select c_custkey as id, 'r1' as role, 'Engineer' as title, 'Acme' as company, {_LABEL.format(f'({_START})')} as start, case when c_custkey % 3 = 0 then 'present' else {_LABEL.format(f'({_END})')} end as "end", {_END} - ({_START}) + 1 as months, case when c_custkey % 3 = 0 then 'month' else 'year' end as precision from customer
    union all select c_custkey, 'r2', 'Analyst', 'Beta Ltd', '2003-01', '2004-12', 24, 'year' from customer)"""


def people(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as id", f"{PERSON_TEXT} as text")


@query(f"with {SQL_ROLES} select * from jobs")
def resume_roles(spark, sf_dir):
    return B.roles(people(spark, sf_dir), "2024-05-01")


@query("select c_custkey as id, bullet, role, text, n from customer, (values ('b1', 'r1', 'Built Python pipelines, 20% faster', 1), ('b2', 'r1', 'SQL and Airflow', 0), ('b3', 'r2', 'Moved to Python', 0)) b(bullet, role, text, n)")
def resume_bullets(spark, sf_dir):
    return B.bullets(people(spark, sf_dir), "2024-05-01").select("id", "bullet", "role", "text", F.size("measures").alias("n"))


@query("""select c_custkey as id, 'MSc in Physics, Rome University, 1998 - 2003' as text, 'Master''s' as degree, 'Rome University' as institution, '1998' as start, '2003' as "end" from customer""")
def resume_schools(spark, sf_dir):
    return B.schools(people(spark, sf_dir))


@query(f"""with {SQL_ROLES}, m as (select id, max(months) filter (role = 'r1') as a from jobs group by id) select id, skill, evidence, case when n = 2 then a + 24 when n = 1 then a else 0 end as months,
    case when n > 0 then case when id % 3 = 0 then 'present' else (select max("end") from jobs j where j.id = m.id) end else '' end as last_used, source, strength
    from m, (values ('Python', 'b1,b3', 2, 'experience', 'strong'), ('SQL', 'b2', 1, 'experience', 'moderate'), ('Airflow', 'b2', 1, 'experience', 'moderate'), ('Docker', '', 0, 'skills_list', 'weak'), ('Kafka', '', 0, 'skills_list', 'weak')) s(skill, evidence, n, source, strength)""")
def resume_skills(spark, sf_dir):
    found = B.skill_evidence(people(spark, sf_dir), TAX, "2024-05-01")
    return found.select("id", "skill", F.array_join("evidence", ",").alias("evidence"), "months", "last_used", "source", "strength")


@query("select c_custkey as id, false as extractable, true as headings, true as contact, true as one_column, false as length_ok, false as dated, true as measured from customer")
def resume_form(spark, sf_dir):
    return B.form_checks(people(spark, sf_dir), "2024-05-01")


@query(f"with {SQL_ROLES} select id, cast(months + case when id % 2 = 0 then 12 else 0 end as bigint) as months from jobs where role = 'r1'")
def corrected_experience(spark, sf_dir):
    """Everyone ignores the second role; every other one lets the first begin a year before."""
    jobs = B.roles(people(spark, sf_dir), "2024-05-01")
    year = F.concat((F.substring("start", 1, 4).cast("int") - 1).cast("string"), F.substring("start", 5, 3))
    blank = F.lit(None).cast("string")
    told = jobs.select("id", "role", blank.alias("title"), blank.alias("company"), F.when((F.col("role") == "r1") & (F.col("id") % 2 == 0), year).alias("start"), blank.alias("end"), (F.col("role") == "r2").alias("ignore"))
    return B.corrected_months(B.corrected(jobs, told, 2024 * 12 + 4))


@query("select c_custkey as id, 'Data Engineer' as first, false as named from customer")
def resumes_without_identity(spark, sf_dir):
    text = B.without_identity(F.col("text"))
    return people(spark, sf_dir).select("id", text.alias("t")).select("id", F.element_at(F.split("t", "\n"), 1).alias("first"), F.col("t").rlike("Jane|she/her|@").alias("named"))
