"""Registered queries on the store and on evaluation runs over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import records as R
from .postings import postings
from .queries import P, query, rows, table


@query("select o_orderkey, o_orderstatus from orders where o_custkey % 2 = 0 union all select o_orderkey, 'saved anew' from orders where o_custkey % 2 = 1 and o_orderkey % 3 = 0 union all select o_orderkey, o_orderstatus from orders where o_custkey % 2 = 1 and o_orderkey % 3 <> 0")
def replaced_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = o.where("o_custkey % 2 = 1 and o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("saved anew"))
    return R.replaced(o, new, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("select o_custkey as analysis, list_position(ids, l_orderkey) - 1 as pos, l_orderkey as job_id, status from (select o_custkey, list(o_orderkey order by o_orderkey desc) as ids from orders group by 1) a, (select o_orderkey as l_orderkey, o_orderstatus as status from orders where o_orderkey % 5 <> 0) b where list_contains(ids, l_orderkey)")
def jobs_in_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    lists = o.groupBy(F.col("o_custkey").alias("analysis")).agg(F.reverse(F.array_sort(F.collect_list("o_orderkey"))).alias("ids"))
    stored = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"))
    return R.in_order(lists, stored, "ids", "job_id").select("analysis", F.col("pos").cast("long").alias("pos"), "job_id", "status")


@query("select doc_id, case when doc_id % 2 = 0 then 'first' else 'second' end as reviewer from documents")
def labels_once(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    first = d.where("doc_id % 2 = 0").withColumn("reviewer", F.lit("first"))
    return R.inserted_once(first, d.withColumn("reviewer", F.lit("second")), ["doc_id"])


@query("select page_id, case when page_id % 3 = 0 then 'ok' else 'new' end as status, case when page_id % 3 = 0 then url end as title from pages")
def link_results(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.lit("new").alias("status"), F.lit(None).cast("string").alias("title"))
    got = table(spark, sf_dir, "pages").where("page_id % 3 = 0").select("page_id", F.lit("ok").alias("status"), F.col("url").alias("title"))
    return R.updated(links, got, "page_id", ["status", "title"])


@query("select event_id as watch_id from events where user_id % 2 = 0 and ts <= timestamp '2024-01-10' order by ts, event_id limit 20")
def due_watches(spark, sf_dir):
    w = table(spark, sf_dir, "events").select(F.col("event_id").alias("watch_id"), (F.col("user_id") % 2 == 0).alias("active"), F.col("ts").alias("next_run_at"))
    return R.due(w, "2024-01-10").select("watch_id")


@query("select event_id from events where ts + interval 20 day > timestamp '2024-01-25' order by ts desc, event_id limit 200")
def kept_in_store(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("expires_at", F.col("ts") + F.expr("interval 20 days"))
    return R.newest_within(e, "2024-01-25", 200, "ts", "event_id").select("event_id")


@query("select doc_id, doc_id + case when doc_id % 7 = 0 then (select max(doc_id) + 1 from documents) else 0 end as place from documents")
def queue_after_skips(spark, sf_dir):
    q = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("place"))
    return R.to_the_back(q, q.where("doc_id % 7 = 0"), "doc_id")


@query("select 'events' as name, count(*) as n from events where user_id = 7 union all select 'orders', count(*) from orders where o_custkey = 7")
def owner_export(spark, sf_dir):
    tables = {"events": table(spark, sf_dir, "events").withColumn("owner", F.concat(F.lit("u:"), "user_id")), "orders": table(spark, sf_dir, "orders").withColumn("owner", F.concat(F.lit("u:"), "o_custkey"))}
    found = R.owned(tables, "u:7").where("get_json_object(row, '$.owner') = 'u:7'").groupBy("name").agg(F.count("*").alias("n"))
    return rows(spark, [("events",), ("orders",)], "name string").join(found, "name", "left").fillna(0)


@query("""select 'calls' as name, 'app_calls{kind="' || event_type || '"} ' || count(*) as line from events group by event_type union all select 'users', 'app_users ' || count(distinct user_id) from events""")
def metric_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    calls = e.select(F.lit("calls").alias("name"), F.create_map(F.lit("kind"), "event_type").alias("labels"), F.lit(1.0).alias("value"))
    users = e.select("user_id").distinct().select(F.lit("users").alias("name"), F.create_map().cast("map<string, string>").alias("labels"), F.lit(1.0).alias("value"))
    return R.metric_lines(calls.unionByName(users))


@query("""with s as (select user_id as watch, event_id as id, event_type as title, cast(floor(value) as int) as score, row_number() over (partition by user_id order by floor(value) desc, event_id) as n from events)
    select watch, count(*) as n, array_to_string(list(id order by n) filter (n <= 25), ',') as ids, array_to_string(list('- ' || title || ' (' || score || ')' order by n) filter (n <= 15), chr(10)) as text from s group by watch""")
def watch_digests(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("watch"), F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.floor("value").cast("int").alias("score"))
    return R.digests(e, "watch").select("watch", "n", F.array_join(F.transform("matches", lambda m: m["id"].cast("string")), ",").alias("ids"), "text")


@query(f"with {P} select s.source, count(id) as jobs, count(id) > 0 as ok from (values ('greenhouse'), ('lever'), ('linkedin'), ('adzuna'), ('remotive'), ('ashby')) s(source) left join p using (source) group by s.source")
def source_canaries(spark, sf_dir):
    sources = rows(spark, [(s,) for s in ("greenhouse", "lever", "linkedin", "adzuna", "remotive", "ashby")], "source string")
    return R.canaries(postings(spark, sf_dir), sources)


@query(f"""with {P}, r(ats, slug, jobs) as (values ('lever', 'acme-1', 4), ('lever', 'acme1', 4), ('greenhouse', 'acme', 9), ('greenhouse', 'acme1hq', 12), ('ashby', 'acme1', -1), ('ashby', 'acme2inc', 3)),
    n as (select distinct company, 'acme' as a, regexp_extract(lower(company), 'acme (\\d+)', 1) as k from p), c as (select company, unnest([a || k, a || '-' || k, a, a || k || 'inc', a || k || 'hq']) as slug, unnest([0, 1, 2, 3, 4]) as turn from n)
    select company, ats, arg_max(slug, jobs * 10 - turn) as slug, max(jobs) as jobs from c join r using (slug) where jobs >= 0 group by company, ats""")
def company_boards(spark, sf_dir):
    responses = rows(spark, [("lever", "acme-1", 4), ("lever", "acme1", 4), ("greenhouse", "acme", 9), ("greenhouse", "acme1hq", 12), ("ashby", "acme1", -1), ("ashby", "acme2inc", 3)], "ats string, slug string, jobs int")
    return R.boards(postings(spark, sf_dir).select("company").distinct(), responses)


# --- evaluation ------------------------------------------------------------------------------------------------------------

_RUNS = "select event_id as run_id, event_type as suite, 'm' || user_id % 3 as model, value / 100 as quality, case when event_id % 5 <> 0 then value end as cost_usd, user_id as cases, value * 2 as p95_ms, ts as created_at, value from events"


def runs(spark, sf_dir):
    sql = _RUNS.replace("'m' || user_id % 3", "concat('m', cast(user_id % 3 as string))").replace("from events", "from {e}")
    return spark.sql(sql, e=table(spark, sf_dir, "events"))


@query("select count(*) as n, avg(case when quality = toxic then 1.0 else 0.0 end) as accuracy, avg(abs(quality - toxic)) as mean_error from labels")
def label_accuracy(spark, sf_dir):
    return E.accuracy(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(f"""with r as ({_RUNS}), n as (select *, row_number() over (partition by suite, model order by created_at desc, run_id desc) as n, count(*) over (partition by suite, model) as runs from r)
    select suite, model, quality, round(cost_usd / nullif(cases, 0) * 100, 4) as cost_per_100, p95_ms, runs from n where n = 1""")
def leaderboard(spark, sf_dir):
    return E.leaderboard(runs(spark, sf_dir))


@query(f"with r as ({_RUNS}), b as (select suite, value, row_number() over (partition by suite order by created_at desc, run_id desc) as back from r) select suite, row_number() over (partition by suite order by back desc) as n, value from b where back <= 20")
def metric_trend(spark, sf_dir):
    return E.trend(runs(spark, sf_dir), "suite")


@query(f"with r as ({_RUNS}) select suite, count(*) as calls, count(cost_usd) as known, sum(cost_usd) as cost from r group by suite")
def run_spend(spark, sf_dir):
    return E.spend(runs(spark, sf_dir), "suite")


@query("""with c(key, value) as (select event_type, avg(value) from events where ts >= timestamp '2024-01-15' group by 1), b(key, value) as (select event_type, avg(value) from events where ts < timestamp '2024-01-15' group by 1)
    select key, round(b.value, 9) as was, round(c.value, 9) as value from c join b using (key) where case when length(key) % 2 = 0 then b.value - c.value else c.value - b.value end > 0.01 + 1e-9""")
def metric_regressions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mean = lambda rows_: E.flattened(rows_.groupBy("event_type").agg(F.avg("value").alias("v")).select(F.lit("s").alias("suite"), F.create_map("event_type", "v").alias("metrics"))).withColumn("key", F.substring("key", 3, 99))
    heads = e.select(F.col("event_type").alias("key")).distinct().select("key", F.when(F.length("key") % 2 == 0, "+").otherwise("-").alias("direction"), F.lit(0.01).alias("tolerance"))
    found = E.regressions(mean(e.where("ts >= '2024-01-15'")), mean(e.where("ts < '2024-01-15'")), heads)
    return found.select("key", F.round("was", 9).alias("was"), F.round("value", 9).alias("value"))


@query("""with l as (select doc_id as item, 'a' as model, quality as label from labels union all select doc_id, 'b', toxic from labels union all select doc_id, 'c', doc_id % 2 from labels), n as (select item, label, count(*) as n from l group by all)
    select item, cast(sum(n) as bigint) as models, count(*) as distinct, cast(arg_max(label, n * 10 - label) as varchar) as majority, count(*) > 1 as disagree from n group by item""")
def label_agreement(spark, sf_dir):
    x = table(spark, sf_dir, "labels")
    parts = [x.select(F.col("doc_id").alias("item"), F.lit(m).alias("model"), F.col(c).cast("string").alias("label")) if c else x.select(F.col("doc_id").alias("item"), F.lit(m).alias("model"), (F.col("doc_id") % 2).cast("string").alias("label")) for m, c in (("a", "quality"), ("b", "toxic"), ("c", None))]
    return E.label_agreement(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("select count(*) as total, count(*) filter (quality = 1) as reviewed, count(*) filter (toxic = 0) as queue, count(*) filter (doc_id % 3 = 2) as double from labels")
def label_stats(spark, sf_dir):
    return E.label_stats(table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("reviewed"), (F.col("toxic") == 1).alias("done"), (F.col("doc_id") % 3).alias("n_labels")))


@query("select event_type as suite, count(*) as n, round(avg(case when event_id % 4 <> 0 then (event_id % 3 = 0)::int end), 4) as met, round(avg((value > 50)::int), 4) as high from events group by 1")
def suite_rates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("suite"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 3 == 0).alias("met"), (F.col("value") > 50).alias("high"))
    return E.rates(e, "suite", ["met", "high"])


@query("select conv_id as id, case when conv_id % 3 = 0 then 2 else 3 end as n_gold, 3 as n_predicted, case when conv_id % 3 = 0 then 1 else 2 end as n_matched from (select distinct conv_id from conversations)")
def matched_requirements(spark, sf_dir):
    """Two predicted lines are like the first gold line, and only one may have it."""
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()
    sets = lambda *lines: F.array(*(F.lit(line.split(" ")) for line in lines))
    gold = ids.withColumn("lines", F.when(F.col("id") % 3 == 0, sets("python sql spark", "kafka streams")).otherwise(sets("python sql spark", "team lead", "kafka streams")))
    predicted = ids.withColumn("lines", sets("python sql spark", "python sql spark jobs", "team lead"))
    return E.matched_lines(gold, predicted)
