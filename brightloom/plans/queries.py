"""Registered queries of the posting engine over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import spread
from ..functions import text as T
from ..functions.values import NOISE, PHRASES, ROLE_NOUNS, SYNONYMS
from ..operators import evaluation as E
from ..operators import funnel as N
from ..operators import ordering as O
from ..operators import records as R
from ..operators import vectors as X
from ..sources import feeds
from ..streaming import watch
from .postings import NOW, POSTINGS, postings

WANTED = N.Query(title="Data Engineer", now=NOW, location="Berlin, Germany", hours=24 * 365 * 5, workplace=("remote", "onsite"), job_types=("full_time", "contract"), experience=("mid_senior",), count=40)

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, data: list, schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def values(data: list) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in data)


P = f"p as ({POSTINGS})"


def sql_tokens(text: str) -> str:
    plain = f"lower(coalesce({text}, ''))"
    for pattern, word in PHRASES:
        plain = f"regexp_replace({plain}, '{pattern}', '{word}', 'g')"
    known = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in SYNONYMS.items()) + "}"
    return f"list_transform(regexp_extract_all({plain}, '[a-z0-9+#]+'), lambda w: coalesce({known}[w], w))"


def sql_in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def sql_word(text: str, words) -> str:
    told = "|".join(N._quoted(w) for w in sorted(set(words)))
    return f"regexp_matches({text}, '(^|[^a-z])({told})($|[^a-z])')" if told else "false"


SQL_COMPANY = r"regexp_replace(regexp_replace(lower(company), '\b(inc|llc|ltd|limited|gmbh|corp|corporation|co|plc|sa|ag|bv)\b\.?', '', 'g'), '[^a-z0-9]', '', 'g')"
SQL_REMOTE = "coalesce(remote, case when contains(lower(location), 'remote') then true end)"
SQL_CITY = rf"case when trim(location) = '' or (coalesce({SQL_REMOTE}, false) and regexp_matches(lower(location), 'remote|worldwide|anywhere|global')) then 'remote' else regexp_replace(regexp_split_to_array(lower(location), '[,;(/|-]')[1], '[^a-z0-9]', '', 'g') end"
SQL_AGE = f"(epoch(timestamp '{NOW}') - epoch(posted)) / 3600.0"


#: The derived postings and reposts of some: another title, every other one with a word more in its description.
_AGAIN = "select concat(id, '-again') as id, source, company, concat(title, ' II') as title, location, remote, posted, employment_type, salary, case when cast(substr(id, 3) as bigint) % 2 = 0 then description else concat(description, ' New') end as description from {0} where cast(substr(id, 3) as bigint) % 5 < 2"
REPOSTED = f"once as ({POSTINGS}), p as (select id, source, company, title, location, remote, posted, employment_type, salary, description from once union all {_AGAIN.format('once')})"


def reposted(spark, sf_dir) -> DataFrame:
    p = postings(spark, sf_dir).select("id", "source", "company", "title", "location", "remote", "posted", "employment_type", "salary", "description")
    return p.unionByName(spark.sql(_AGAIN.format("{p}"), p=p)).withColumn("url", F.lit(None).cast("string"))


def sql_tagged(relation: str = P) -> str:
    low = "lower(location)"
    parts, fits, of_country, regions = N.location_words(WANTED.location.lower())
    free = f"({low} = '' or {sql_word(low, ['worldwide', 'anywhere', 'global'])} or trim({low}) in ('remote', 'remote (worldwide)'))"
    place = f"({sql_word(low, parts)} or {sql_word(low, fits)} or (coalesce({SQL_REMOTE}, false) and ({free} or {sql_word(low, of_country)} or {sql_word(low, regions)})))"
    return f"""{relation},
        t as (select *, {sql_tokens('title')} as tokens, {sql_tokens("substr(description, 1, 800)")} as ctx from p),
        u as (select *, ['data', 'engineer'] as core, list_filter(tokens, lambda w: w in {sql_in(ROLE_NOUNS)})[-1] as noun from t),
        v as (select *, len(list_filter(core, lambda w: list_contains(tokens, w))) / 2.0 as hits,
            len(list_filter(core, lambda w: not list_contains(tokens, w) and list_contains(ctx, w))) / 2.0 as soft from u),
        r as (select *, case when noun <> 'engineer' then 0.3 when hits >= 1 then 1.0 else least(1.0, hits + 0.4 * soft) end as relevance from v),
        tagged as (select *, case when trim(title) = '' then 'no_title' when relevance < 0.5 and source not in ('url', 'manual', 'linkedin') then 'title'
            when coalesce({SQL_AGE} > {WANTED.hours} + 6, false) then 'too_old' when not {place} then 'location'
            when regexp_matches(lower(employment_type), 'full|permanent|part|contract|freelance|temporary|temp|intern')
                and not regexp_matches(lower(employment_type), 'full|permanent|contract|freelance') then 'job_type'
            when regexp_matches(lower(title), '\\b(intern|internship|junior|jr\\.?|graduate|trainee)\\b') then 'experience' end as "drop" from r)"""


def sql_simhash(rows_: str, key: str, text: str, name: str) -> str:
    """{name} (key, simhash) of rows_."""
    return rf"""{name}_w as (select {key}, regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+') as w from {rows_}),
    {name}_r as (select {key}, unnest(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' '))) as run from {name}_w where len(w) >= 3),
    {name}_h as (select {key}, cast('0x' || substr(md5(run), 1, 16) as ubigint) as h from {name}_r),
    {name}_b as (select {key}, b, sum(case when (h >> b) & 1 = 1 then 1 else -1 end) as v from {name}_h, (select cast(unnest(range(64)) as ubigint) as b) group by {key}, b),
    {name} as (select {key}, cast(sum(case when v > 0 then (case when b = 63 then -9223372036854775808::hugeint else (1::hugeint << b::int) end) else 0 end) as bigint) as simhash from {name}_b group by {key})"""


SQL_ONCE = f"""{sql_tagged(REPOSTED)},
        keyed as (select *, case source when 'greenhouse' then 0 when 'lever' then 0 when 'linkedin' then 2 when 'adzuna' then 4 else 3 end as pri, {SQL_COMPANY} as firm, {SQL_CITY} as city,
            concat_ws('|', {SQL_COMPANY}, regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), {SQL_CITY}) as k from tagged where "drop" is null),
        ordered as (select *, row_number() over (partition by k order by pri, -length(description), id) as n,
            first_value(description) over (partition by k order by -length(description), pri, id) as longest from keyed),
        once_each as (select * exclude (description), case when length(longest) > length(description) + 200 then longest else description end as description from ordered where n = 1)"""

#: The second stage one by one in the order of ids: a leader is who is near none before; others join the first leader they are near.
SQL_MERGED = f"""{SQL_ONCE}, long_ones as (select k, description from once_each where length(description) >= 200), {sql_simhash("long_ones", "k", "description", "sim")},
        turns_ as (select o.k, simhash, concat_ws('|', firm, city) as block, row_number() over (partition by concat_ws('|', firm, city) order by id) as n from once_each o join sim using (k) where simhash <> 0),
        steps(block, n, leaders, k, chosen) as (select block, 0::bigint, []::struct(k varchar, h bigint)[], null::varchar, null::varchar from turns_ group by block
            union all select block, n, case when met is null then list_append(leaders, {{'k': k, 'h': simhash}}) else leaders end, k, coalesce(met, k)
                from (select s.leaders, t.*, list_filter(s.leaders, lambda x: bit_count(xor(x.h, t.simhash)) <= 3)[1].k as met from (select block, n as was, leaders from steps) s join turns_ t on t.block = s.block and t.n = s.was + 1)),
        grouped_ as (select o.*, coalesce(chosen, o.k) as leader from once_each o left join steps on steps.k = o.k),
        again_ as (select * exclude (n, longest), row_number() over (partition by leader order by pri, -length(description), id) as n, first_value(description) over (partition by leader order by -length(description), pri, id) as longest from grouped_),
        merged as (select * exclude (description), case when length(longest) > length(description) + 200 then longest else description end as description from again_ where n = 1),
        ranked as (select *, 0.55 * relevance + 0.30 * least(length(description) / 1500, 1.0)
            + 0.15 * case when posted is null then 0.5 else greatest(0.0, 1 - ({SQL_AGE}) / {WANTED.hours}) end as score from merged)"""


# --- the funnel ----------------------------------------------------------------------------------------------------


@query(f"with {P} select id, array_to_string({sql_tokens('title')}, ' ') as tokens, array_to_string(list_filter({sql_tokens('title')}, lambda w: w not in {sql_in(NOISE)}), ' ') as core, list_filter({sql_tokens('title')}, lambda w: w in {sql_in(ROLE_NOUNS)})[-1] as noun from p")
def title_tokens(spark, sf_dir):
    p = postings(spark, sf_dir)
    return p.select("id", F.array_join(T.norm_tokens(F.col("title")), " ").alias("tokens"), F.array_join(T.core_tokens(F.col("title")), " ").alias("core"), T.role_noun(T.norm_tokens(F.col("title"))).alias("noun"))


@query(f"""with {sql_tagged()} select id, relevance, "drop" from tagged""")
def drop_reasons(spark, sf_dir):
    return N.tagged(postings(spark, sf_dir), WANTED).select("id", "relevance", "drop")


@query(f"""with {sql_tagged()} select source, coalesce("drop", 'kept') as "drop", count(*) as n from tagged group by all""")
def drops_by_source(spark, sf_dir):
    return N.drops_by_source(postings(spark, sf_dir), WANTED)


@query(f"""with recursive {SQL_MERGED} select (select count(*) from tagged) as fetched, (select count(*) from tagged where coalesce("drop", '') not in ('no_title', 'title')) as relevant,
    (select count(*) from keyed) as after_filters, (select count(*) from merged) as unique_rows, least((select count(*) from merged), 40) as selected""")
def funnel_counts(spark, sf_dir):
    """With reposts, some of which the second stage merges."""
    return N.funnel_counts(reposted(spark, sf_dir), WANTED)


@query(f"""with recursive {SQL_MERGED}, turns as (select *, row_number() over (partition by source order by score desc, id) as turn, max(score) over (partition by source) as best from ranked),
    picked as (select source from turns qualify row_number() over (order by turn, best desc, source) <= 40), k as (select source, count(*) as n from keyed group by 1), m as (select source, count(*) as n from merged group by 1), g as (select source, count(*) as n from picked group by 1)
    select source, "drop", count(*) as n from tagged where "drop" is not null group by all union all select k.source, 'duplicate', k.n - coalesce(m.n, 0) from k left join m using (source) where k.n > coalesce(m.n, 0)
    union all select m.source, 'over_limit', m.n - coalesce(g.n, 0) from m left join g using (source) where m.n > coalesce(g.n, 0)""")
def all_drops(spark, sf_dir):
    return N.all_drops(reposted(spark, sf_dir), WANTED)


@query(f"""with recursive {SQL_MERGED}, turns as (select *, row_number() over (partition by source order by score desc, id) as turn, max(score) over (partition by source) as best from ranked)
    select id, source, turn, row_number() over (order by turn, best desc, source) as place from turns qualify place <= 40""")
def fair_pick(spark, sf_dir):
    return N.funnel(reposted(spark, sf_dir), WANTED).select("id", "source", "turn", "place")


@query(f"""with {P}, k as (select *, {SQL_COMPANY} as c, {SQL_CITY} as city, case source when 'greenhouse' then 0 when 'lever' then 0 when 'linkedin' then 2 when 'adzuna' then 4 else 3 end as pri from p)
    select min_by(id, {{'p': pri, 'l': -length(description), 'i': id}}) as id, array_to_string(list_transform(list_sort(list_distinct(list({{'p': pri, 's': source}}))), lambda x: x.s), ',') as sources, count(*) as copies
    from k group by c, regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), city""")
def merged_postings(spark, sf_dir):
    return N.merged(postings(spark, sf_dir).withColumn("url", F.lit(None).cast("string"))).select("id", F.array_join("sources", ",").alias("sources"), "copies")


SQL_SIMHASH = r"""with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as w from documents),
    r as (select doc_id, unnest(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' '))) as run from w where len(w) >= 3),
    h as (select doc_id, cast('0x' || substr(md5(run), 1, 16) as ubigint) as h from r),
    b as (select doc_id, b, sum(case when (h >> b) & 1 = 1 then 1 else -1 end) as v from h, (select cast(unnest(range(64)) as ubigint) as b) group by doc_id, b),
    s as (select doc_id, sum(case when v > 0 then (case when b = 63 then -9223372036854775808::hugeint else (1::hugeint << b::int) end) else 0 end) as simhash from b group by doc_id)
    select doc_id, cast(coalesce(simhash, 0) as bigint) as simhash from documents left join s using (doc_id)"""


@query(SQL_SIMHASH)
def simhash(spark, sf_dir):
    return N.simhash(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""with recursive s0 as ({SQL_SIMHASH}), d as (select source, doc_id as id, simhash from s0 join documents using (doc_id)),
    links as (select a.id as a, b.id as b from d a join d b on a.source = b.source and a.id <> b.id and a.simhash <> 0 and b.simhash <> 0 and bit_count(xor(a.simhash, b.simhash)) <= 3),
    reach(id, other) as (select id, id from d union select r.id, l.b from reach r join links l on l.a = r.other)
    select source, id, min(other) as class_id, (select count(*) from links where a = id) as n_links from reach join d using (id) group by source, id""")
def near_duplicates(spark, sf_dir):
    """Each document's class within its source by SimHashes that differ in at most three bits, and its number of links."""
    docs = table(spark, sf_dir, "documents")
    hashes = spread(docs.select(F.col("doc_id").alias("id"), "source", "text"), "id").select("source", "id", N.simhash_of(F.col("text")).alias("simhash"))
    return N.near_classes(hashes, ["source"])


# --- market statistics -----------------------------------------------------------------------------------------------


@query(f"""with {P}, s as (select regexp_extract(salary, '([$£€])', 1) as currency, replace(regexp_extract(salary, '[$£€](\\d[\\d,]*)', 1), ',', '') as a, regexp_extract(salary, '- [$£€](\\d[\\d,]*)', 1) as b, salary from p where salary <> ''),
    y as (select currency, (cast(a as double) * k + case when b = '' then cast(a as double) else cast(replace(b, ',', '') as double) end * k) / 2 * m as yearly
        from (select *, case when contains(salary, 'k') then 1000 else 1 end as k, case when contains(salary, 'hour') then 2080 when contains(salary, 'month') then 12 else 1 end as m from s)),
    l as (select currency, count(*) as n, median(yearly) as median, list(yearly order by yearly) as v from y where yearly between 8000 and 1500000 group by currency having count(*) >= 3)
    select currency, n, median, v[1 + cast(floor(0.25 * (n - 1) + 0.5) as int)] as p25, v[1 + cast(floor(0.75 * (n - 1) + 0.5) as int)] as p75 from l""")
def salary_quartiles(spark, sf_dir):
    """Distinct amounts are counted, and placed by running totals over ranges, so that no currency is one task."""
    found = postings(spark, sf_dir).select(T.salary_point(F.col("salary")).alias("s")).where("s is not null").groupBy("s.currency", "s.yearly").agg(F.count("*").alias("c"))
    rank = lambda p: lambda n: F.floor(p * (n - 1) + 0.5)
    placed = O.at_places(found, ["currency"], "yearly", "c", {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2), "p25": rank(0.25), "p75": rank(0.75)})
    return placed.where("total >= 3").select("currency", F.col("total").alias("n"), ((F.col("low") + F.col("high")) / 2).alias("median"), "p25", "p75")


@query(f"with {P} select strftime(posted, '%G-W%V') as week, count(*) as n from p where posted is not null group by 1 order by 1 desc limit 12")
def weekly_counts(spark, sf_dir):
    p = postings(spark, sf_dir).where("posted is not null")
    return p.groupBy(R.iso_week(F.col("posted")).alias("week")).agg(F.count("*").alias("n")).orderBy(F.desc("week")).limit(12)


@query(f"with {P} select location, count(*) as n, count(*) filter ({SQL_REMOTE}) as away from p where location <> '' group by location order by n desc, location limit 10")
def top_locations(spark, sf_dir):
    p = postings(spark, sf_dir).where("location <> ''")
    return p.groupBy("location").agg(F.count("*").alias("n"), F.count_if(T.is_remote(F.col("remote"), F.col("location"))).alias("away")).orderBy(F.desc("n"), "location").limit(10)


@query(f"with {P} select id from p where posted >= timestamp '1998-01-01' and (title ilike '%data%' or title ilike '%engineer%')")
def title_prefilter(spark, sf_dir):
    return postings(spark, sf_dir).where((F.col("posted") >= "1998-01-01") & (F.col("title").ilike("%data%") | F.col("title").ilike("%engineer%"))).select("id")


@query(f"""with {P} select case when posted is null then 'unknown' when {SQL_AGE} <= 24 * 31 then 'month' when {SQL_AGE} <= 24 * 366 then 'year' else 'older' end as recency, count(*) as n from p group by 1""")
def recency_buckets(spark, sf_dir):
    age = T.age_hours(F.col("posted"), NOW)
    bucket = F.when(age.isNull(), "unknown").when(age <= 24 * 31, "month").when(age <= 24 * 366, "year").otherwise("older")
    return postings(spark, sf_dir).groupBy(bucket.alias("recency")).agg(F.count("*").alias("n"))


# --- the store -------------------------------------------------------------------------------------------------------


@query("select l_orderkey as search_id, l_linenumber as rank, p_partkey as job_id, p_name as title from lineitem join part on p_partkey = l_partkey")
def search_results(spark, sf_dir):
    """Results of all searches; one search's are those of its id, by rank."""
    found, jobs = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    met = found.join(jobs, F.col("l_partkey") == F.col("p_partkey"))
    return met.select(F.col("l_orderkey").alias("search_id"), F.col("l_linenumber").alias("rank"), F.col("p_partkey").alias("job_id"), F.col("p_name").alias("title"))


@query("select o_custkey as watch_id, max(o_orderkey) as digest_id, arg_max(o_orderstatus, o_orderkey) as status from orders group by o_custkey")
def latest_digest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("watch_id"), F.col("o_orderkey").alias("digest_id"), F.col("o_orderstatus").alias("status"))
    return R.latest(o, "watch_id", "digest_id", ["digest_id", "status"])


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= timestamp '1997-01-01')")
def fresh_jobs(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").where("o_orderdate >= '1997-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return R.unseen(table(spark, sf_dir, "customer").select("c_custkey"), seen, ["c_custkey"])


@query("""with stored as (select doc_id as id, source as feature, n_chars as last_seen, n_chars as first_seen from documents where doc_id % 3 < 2),
    arriving as (select doc_id as id, case when doc_id % 2 = 0 then lang end as feature, n_chars + 1 as last_seen, n_chars + 1 as first_seen from documents where doc_id % 3 > 0)
    select coalesce(a.id, b.id) as id, coalesce(b.feature, a.feature) as feature, coalesce(b.last_seen, a.last_seen) as last_seen, coalesce(a.first_seen, b.first_seen) as first_seen from stored a full join arriving b on a.id = b.id""")
def upsert_jobs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    stored = d.where("doc_id % 3 < 2").selectExpr("doc_id as id", "source as feature", "n_chars as last_seen", "n_chars as first_seen")
    new = d.where("doc_id % 3 > 0").selectExpr("doc_id as id", "case when doc_id % 2 = 0 then lang end as feature", "n_chars + 1 as last_seen", "n_chars + 1 as first_seen")
    return R.upsert(stored, new, "id", ["first_seen"], ["feature"])


@query("select event_id from events where event_id % 5 = 0 or ts > timestamp '2024-01-15'")
def unexpired(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("expires_at", F.when(F.col("event_id") % 5 != 0, F.col("ts")))
    return R.alive(e, "2024-01-15").select("event_id")


@query("select event_type as agent, count(*) as calls, coalesce(sum(case when event_id % 7 <> 0 then value end), 0) as cost, count(*) filter (event_id % 7 = 0) = 0 as cost_known, avg(case when event_id % 3 = 0 then 1.0 else 0.0 end) as cache_ratio from events where ts > timestamp '2024-01-20' group by 1")
def agent_spend(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("ts > '2024-01-20'").withColumn("cost_usd", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return e.groupBy(F.col("event_type").alias("agent")).agg(F.count("*").alias("calls"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost"), F.bool_and(F.col("cost_usd").isNotNull()).alias("cost_known"), F.avg((F.col("event_id") % 3 == 0).cast("double")).alias("cache_ratio"))


@query("select case doc_id % 3 when 0 then 'fit' when 1 then 'gate' else 'skill' end as kind, count(*) as n, count(*) filter (quality = 1) as up, count(*) filter (quality = 0) as down, round(count(*) filter (quality = 1) / nullif(count(quality), 0), 3) as approval from labels group by 1")
def feedback_summary(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "fit").when(F.col("doc_id") % 3 == 1, "gate").otherwise("skill")
    up, down = F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)
    return table(spark, sf_dir, "labels").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), up.alias("up"), down.alias("down"), F.round(F.try_divide(up, up + down), 3).alias("approval"))


@query("select user_id as run_id, event_id, row_number() over (partition by user_id order by ts, event_id) as seq from events qualify seq <= 2000")
def event_sequence(spark, sf_dir):
    return R.numbered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 2000).select(F.col("user_id").alias("run_id"), "event_id", "seq")


@query("select user_id, event_id, event_type as stage from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as was from events) where was is distinct from event_type")
def stage_history(spark, sf_dir):
    return R.changes(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("stage")), "user_id", ["ts", "event_id"], "stage").drop("ts")


SPANS = "o_custkey as person, year(o_orderdate) * 12 + month(o_orderdate) - 1 as s, year(o_orderdate) * 12 + month(o_orderdate) - 1 + o_orderkey % 9 as e"


@query(f"""with spans as (select {SPANS} from orders), a as (select *, case when s > max(e) over (partition by person order by s, e rows between unbounded preceding and 1 preceding) + 1 then 1 else 0 end as f from spans),
    b as (select *, sum(f) over (partition by person order by s, e rows unbounded preceding) as island from a), c as (select person, island, max(e) - min(s) + 1 as m from b group by all) select person, cast(sum(m) as bigint) as months from c group by person""")
def experience_months(spark, sf_dir):
    return R.merged_months(table(spark, sf_dir, "orders").selectExpr(*SPANS.split(", ")), "person", "s", "e")


@query("""select doc_id, case when toxic = 1 then 'disagreement' else 'sample' end as reason from labels where toxic = 1 or cast('0x' || substr(md5('review' || doc_id), 1, 8) as bigint) < 858993459""")
def review_sample(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return R.sampled(labels.select("doc_id"), "doc_id", labels.where("toxic = 1"), 0.2, "review")


# --- evaluation --------------------------------------------------------------------------------------------------------

JUDGED = "select l.doc_id, quality, toxic, n_chars, least(1.0, n_chars / 4000.0) as confidence from labels l join documents d on d.doc_id = l.doc_id"


def judged(spark, sf_dir):
    rows_ = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows_.withColumn("confidence", F.least(F.lit(1.0), F.col("n_chars") / 4000.0))


@query(f"""with j as ({JUDGED}), c as (select count(*) filter (quality = 1 and n_chars >= 800) as tp, count(*) filter (quality <> 1 and n_chars >= 800) as fp, count(*) filter (quality = 1 and n_chars < 800) as fn from j)
    select tp, fp, fn, tp / (tp + fp) as precision, tp / (tp + fn) as recall, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) as f1 from c""")
def precision_recall(spark, sf_dir):
    return E.precision_recall(judged(spark, sf_dir), F.col("quality") == 1, F.col("n_chars") >= 800)


@query(f"""with j as ({JUDGED}), r as (select rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2 as a, rank() over (order by quality) + (count(*) over (partition by quality) - 1) / 2 as b from j) select count(*) as n, round(corr(a, b), 9) as rho from r""")
def spearman(spark, sf_dir):
    return E.spearman(judged(spark, sf_dir), "n_chars", "quality").select("n", F.round("rho", 9).alias("rho"))


@query(f"""with j as ({JUDGED}), b as (select least(9, floor(confidence * 10)) as bin, count(*) as n, avg(confidence) as c, avg(quality) as r from j group by 1) select round(sum(n * abs(r - c)) / sum(n), 9) as ece from b""")
def calibration_error(spark, sf_dir):
    return E.calibration_error(judged(spark, sf_dir), "confidence", F.col("quality") == 1).select(F.round("ece", 9).alias("ece"))


@query(f"""with j as ({JUDGED}) select cast(least(9, floor(confidence * 10)) as int) as bin, count(*) as n, round(avg(confidence), 9) as confidence, round(avg(quality), 9) as rate from j group by 1""")
def reliability_table(spark, sf_dir):
    return E.reliability(judged(spark, sf_dir), "confidence", F.col("quality") == 1).withColumns({"confidence": F.round("confidence", 9), "rate": F.round("rate", 9)})


@query(f"""with j as ({JUDGED}), n as (select count(*) as n, avg(case when quality = toxic then 1.0 else 0.0 end) as po, sum(quality) / count(*) as qa, sum(toxic) / count(*) as qb from j) select n, round((po - (qa * qb + (1 - qa) * (1 - qb))) / (1 - (qa * qb + (1 - qa) * (1 - qb))), 9) as kappa from n""")
def cohen_kappa(spark, sf_dir):
    return E.kappa(judged(spark, sf_dir), "quality", "toxic").select("n", F.round("kappa", 9).alias("kappa"))


@query("with l as (select event_type, list(value order by value) as v from events group by 1) select event_type, median as p50, v[1 + least(len(v) - 1, cast(floor(0.95 * len(v)) as int))] as p95 from (select event_type, v, list_aggregate(v, 'median') as median from l)")
def latency_percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    placed = O.at_places(e, ["event_type"], "value", "c", {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2), "p95": lambda n: F.least(n - 1, F.floor(0.95 * n))})
    return placed.select("event_type", ((F.col("low") + F.col("high")) / 2).alias("p50"), "p95")


# --- text, vectors, streams, sources -----------------------------------------------------------------------------------


@query(rf"""select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{T.EMAIL}', '[email]', 'g'), '{T.LINK.replace("'", "''")}', '[link]', 'g'), '{T.PHONE}', '[phone]', 'g') as text from documents where regexp_matches(text, '{T.EMAIL}') or regexp_matches(text, '{T.PHONE}')""")
def without_identity(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(T.EMAIL) | F.col("text").rlike(T.PHONE))
    return d.select("doc_id", T.without_identity(F.col("text")).alias("text"))


@query("""with q as (select vec_id as q, embedding as e from embeddings where vec_id % 100 = 0), s as (select q, v.vec_id, list_inner_product(e::double[], v.embedding::double[]) as cosine from q, embeddings v where v.vec_id <> q)
    select q, vec_id, round(cosine, 6) as cosine from (select *, row_number() over (partition by q order by round(cosine, 9) desc, vec_id) as n from s) where n <= 5""")
def nearest_vectors(spark, sf_dir):
    """Every row whose id is a multiple of 100 is a query against all vectors, a block of queries at a time."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return X.nearest(e, e.where("vec_id % 100 = 0"), 5).select("q", "vec_id", F.round("cosine", 6).alias("cosine"))


@query("select time_bucket(interval '1 day', ts) as day, event_type, count(*) as n, sum(value) as total from events group by all")
def event_windows(spark, sf_dir):
    return watch.windowed(table(spark, sf_dir, "events"))


@query(f"with {P} select 'greenhouse-acme-' || id as id, title, 'Acme' as company, location, posted, 'We ship.' || chr(10) || chr(10) || '• ' || title as description from p where source = 'greenhouse'")
def greenhouse_feed(spark, sf_dir):
    """Recorded responses are made of the derived postings, 100 of them each, and read as the feed's."""
    p = postings(spark, sf_dir).where("source = 'greenhouse'")
    item = F.struct("id", "title", F.struct(F.col("location").alias("name")).alias("location"), F.date_format("posted", "yyyy-MM-dd'T'HH:mm:ss").alias("first_published"), F.concat(F.lit("<p>We ship.</p><ul><li>"), F.col("title"), F.lit("</li></ul>")).alias("content"))
    pages = p.groupBy(F.pmod(F.xxhash64("id"), F.lit(64)).alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias("jobs"))).alias("payload"))
    return feeds.read_feed(pages.select(F.lit("acme").alias("slug"), "payload"), "greenhouse").select("id", "title", "company", "location", "posted", "description")


@query("select page_id, length(url) as url_length from pages where url is not null and regexp_matches(url, '^https?://[^/]+\\.[a-z]{2,}(/|$)')")
def plausible_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.where(F.col("url").rlike(r"^https?://[^/]+\.[a-z]{2,}(/|$)")).select("page_id", F.length("url").cast("long").alias("url_length"))


@query("select count(*) as conversations, sum(n) as turns, max(n) as longest from (select conv_id, count(*) as n from conversations group by conv_id)")
def conversation_turns(spark, sf_dir):
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("conversations"), F.sum("n").alias("turns"), F.max("n").alias("longest"))


@query(f"""with recursive {SQL_MERGED}, s as (select leader, count(*) as n from grouped_ group by leader) select count(*) as reposts, sum(n - 1) as merged_away, max(n) as largest from s where n > 1""")
def merged_reposts(spark, sf_dir):
    """How many groups the second stage makes of what the first leaves, how many rows go into others, and the largest group."""
    kept = N.tagged(reposted(spark, sf_dir), WANTED).where("drop is null")
    sizes = N.greedy_groups(N.merged(kept)).groupBy("_class").agg(F.count("*").alias("n")).where("n > 1")
    return sizes.agg(F.count("*").alias("reposts"), F.sum(F.col("n") - 1).alias("merged_away"), F.max("n").alias("largest"))
