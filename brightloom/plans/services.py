"""Registered queries on recorded feeds, token buckets, search intents, edits, nested settings and suites, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..durable import delete_at_end, durable, shared_dir
from ..functions.text import age_hours
from ..functions.values import NOISE
from ..operators import edits as D
from ..operators import evaluation as E
from ..operators import intent as I
from ..operators import limits as L
from ..operators import matching as M
from ..operators import nested as J
from ..operators import records
from ..operators import resumes as R
from ..operators import suites as U
from ..operators.calibration import FEATURES, Calibration
from ..operators.insights import insights
from ..operators.tables import recency
from ..sources import entries, plugin
from .postings import postings
from .queries import WANTED, P, query, sql_in, sql_tagged, sql_tokens, table
from .scoring import _OWNED, PROFILE, SQL_SCORES, all_scores
from .store import _RUNS, runs

# --- recorded feeds: every posting comes back from one of the 17 feeds ------------------------------------------------------

#: feed: what an item is, in SQL over n, title, company, place, ts, day, text; and how items make a payload.
_HTML = "concat('<p>', text, '</p>')"
_XML = "array_join(collect_list(item), '')"
ITEMS = {
    "remotive": ("named_struct('id', n, 'title', title, 'company_name', company, 'candidate_required_location', place, 'publication_date', ts, 'description', {h}, 'job_type', 'full_time')", "to_json(struct(collect_list(item) as jobs))"),
    "remoteok": ("named_struct('id', n, 'position', title, 'company', company, 'location', place, 'date', ts, 'description', {h})", "to_json(array_append(collect_list(item), named_struct('id', cast(null as string), 'position', 'legal', 'company', '', 'location', '', 'date', '', 'description', '')))"),
    "arbeitnow": ("named_struct('slug', n, 'title', title, 'company_name', company, 'location', place, 'remote', true, 'created_at', epoch, 'description', {h})", "to_json(struct(collect_list(item) as data))"),
    "jobicy": ("named_struct('id', n, 'jobTitle', title, 'companyName', company, 'jobGeo', place, 'pubDate', ts, 'jobDescription', '', 'jobExcerpt', text, 'jobType', array('Full-Time'))", "to_json(struct(collect_list(item) as jobs))"),
    "himalayas": ("named_struct('guid', n, 'title', title, 'companyName', company, 'locationRestrictions', if(place = '', array(), array(place)), 'pubDate', epoch, 'description', {h})", "to_json(struct(collect_list(item) as jobs))"),
    "themuse": ("named_struct('id', n, 'name', title, 'company', struct(company as name), 'locations', array(struct(place as name)), 'publication_date', ts, 'contents', {h})", "to_json(struct(collect_list(item) as results))"),
    "greenhouse": ("named_struct('id', n, 'title', title, 'company_name', company, 'location', struct(place as name), 'first_published', ts, 'content', {h})", "to_json(struct(collect_list(item) as jobs))"),
    "lever": ("named_struct('id', n, 'text', title, 'categories', struct(place as location), 'createdAt', ts, 'descriptionPlain', text)", "to_json(collect_list(item))"),
    "ashby": ("named_struct('id', n, 'title', title, 'location', place, 'publishedAt', ts, 'descriptionPlain', '', 'descriptionHtml', {h}, 'isRemote', false)", "to_json(struct(collect_list(item) as jobs))"),
    "smartrecruiters": ("named_struct('id', n, 'name', title, 'company', struct(company as name), 'location', struct(place as city, '' as region, '' as country), 'releasedDate', ts)", "to_json(struct(collect_list(item) as content))"),
    "workable": ("named_struct('shortcode', n, 'title', title, 'city', place, 'state', '', 'country', '', 'created_at', ts, 'description', {h}, 'telecommuting', true)", "to_json(struct('' as name, collect_list(item) as jobs))"),
    "recruitee": ("named_struct('id', n, 'title', title, 'company_name', company, 'location', '', 'city', place, 'country', '', 'published_at', ts, 'description', text, 'requirements', '')", "to_json(struct(collect_list(item) as offers))"),
    "personio": ("concat('<position><id>', n, '</id><name>', title, '</name><office>', place, '</office><createdAt>', coalesce(ts, ''), '</createdAt><jobDescriptions><jobDescription><name>About</name><value>', text, '</value></jobDescription></jobDescriptions></position>')", f"concat('<workzag-jobs>', {_XML}, '</workzag-jobs>')"),
    "teamtailor": ("concat('<item><title>', title, '</title><link>https://x.example.com/jobs/', n, '</link><guid>g', n, '</guid><pubDate>', coalesce(mail, ''), '</pubDate><description>', text, '</description><location>', place, '</location></item>')", f"concat('<rss><channel>', {_XML}, '</channel></rss>')"),
    "workday": ("named_struct('title', title, 'externalPath', concat('/job/x_', n), 'locationsText', place, 'postedOn', 'Posted 3 Days Ago')", "to_json(struct(collect_list(item) as jobPostings))"),
    "usajobs": ("named_struct('MatchedObjectDescriptor', named_struct('PositionID', n, 'PositionTitle', title, 'OrganizationName', company, 'PositionLocationDisplay', place, 'PublicationStartDate', ts, 'QualificationSummary', 'Any', 'UserArea', struct(struct(text as JobSummary) as Details)))", "to_json(struct(struct(collect_list(item) as SearchResultItems) as SearchResult))"),
    "adzuna": ("named_struct('id', n, 'title', title, 'company', struct(company as display_name), 'location', struct(place as display_name), 'created', ts, 'description', text)", "to_json(struct(collect_list(item) as results))"),
}
SLUGS = {"workday": "acme/wd1/jobs"}
PAGE = 200  #: postings of a payload, roughly
_OWN_COMPANY = ("lever", "ashby", "workable", "personio", "teamtailor", "workday")
_PREFIXED = ("greenhouse", "lever", "ashby", "smartrecruiters", "workable", "recruitee", "personio", "teamtailor", "workday")


def payloads(spark, sf_dir):
    """feed, slug, payload: the derived postings dealt over all feeds, some hundred to a payload."""
    p = postings(spark, sf_dir).select(
        F.substring("id", 3, 20).alias("n"), "title", "company", F.col("location").alias("place"), F.date_format("posted", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.unix_seconds(F.col("posted").cast("timestamp")).cast("string").alias("epoch"),
        F.date_format("posted", "EEE, d MMM yyyy HH:mm:ss 'GMT'").alias("mail"), F.concat(F.lit("We ship "), "title").alias("text"),
    )
    p = durable(p.withColumns({"k": F.pmod(F.col("n").cast("long"), F.lit(len(ITEMS))).cast("int"), "page": F.xxhash64("n")}))
    pages = max(16, p.count() // (len(ITEMS) * PAGE))  # more postings make more payloads, not longer ones
    p = p.withColumn("page", F.pmod("page", F.lit(pages)))
    out = None
    for k, (feed, (item, wrap)) in enumerate(ITEMS.items()):
        own = p.where(F.col("k") == k).select("page", F.expr(item.replace("{h}", _HTML)).alias("item")).groupBy("page").agg(F.expr(wrap).alias("payload"))
        told = own.select(F.lit(feed).alias("feed"), F.lit(SLUGS.get(feed, "acme")).alias("slug"), "payload")
        out = told if out is None else out.unionByName(told)
    return out


_FEED = f"([{', '.join(repr(f) for f in ITEMS)}])[1 + cast(cast(substr(id, 3) as bigint) % {len(ITEMS)} as int)]"


@query(f"""with {P}, f as (select *, {_FEED} as feed, substr(id, 3) as n from p)
    select case when feed = 'himalayas' then 'himalayas-' || substr(md5(n), 1, 12) when feed in {sql_in(_PREFIXED)} then feed || '-acme-' || n else feed || '-' || n end as id, feed as source, title, case when feed in {sql_in(_OWN_COMPANY)} then 'Acme' else company end as company,
        case when location <> '' then location when feed in ('remotive', 'remoteok', 'arbeitnow', 'jobicy') then 'Remote' when feed = 'himalayas' then 'Remote (worldwide)' else '' end as location, case when feed = 'workday' then null else posted end as posted,
        case when feed in ('smartrecruiters', 'workday') then '' when feed = 'personio' then 'About' || chr(10) || 'We ship ' || title when feed = 'usajobs' then 'We ship ' || title || chr(10) || chr(10) || 'Qualifications' || chr(10) || 'Any' else 'We ship ' || title end as description from f""")
def all_feeds(spark, sf_dir):
    """Recorded responses of all 17 feeds, landed in the shared folder and scanned by the data source."""
    path = f"{shared_dir(spark)}/brightloom-feeds-{uuid.uuid4().hex}"
    plugin.record(payloads(spark, sf_dir), path)
    delete_at_end(spark, path)
    return plugin.all_postings(spark, path).select("id", "source", "title", "company", "location", "posted", "description")


# --- limits ------------------------------------------------------------------------------------------------------------------


@query("""with recursive e as (select event_id, event_type, epoch_us(ts) as us, (1 + event_id % 3) * 3600000000 as cost, row_number() over (partition by event_type order by ts, event_id) as n from events),
    b(event_type, n, us, tokens, allowed, event_id) as (select event_type, n, us, 10800000000 - cost, true, event_id from e where n = 1
        union all select event_type, n, us, case when t >= cost then t - cost else t end, t >= cost, event_id from (select e.*, least(10800000000, b.tokens + (e.us - b.us) * 3) as t from b join e on e.event_type = b.event_type and e.n = b.n + 1))
    select event_id, allowed, round(tokens / 3600000000, 6) as tokens from b""")
def rate_limited(spark, sf_dir):
    """A bucket of three tokens an hour for each type of event; five hot keys hold all events."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", (F.col("event_id") % 3 + 1).alias("cost"))
    return L.rate_limited(e, "event_type", "ts", "event_id", 3, "cost").select("event_id", "allowed", F.round("tokens", 6).alias("tokens"))


# --- intents -----------------------------------------------------------------------------------------------------------------

_INTENT = """case cast(length(title) % 4 as int) when 0 then concat(title, ' jobs in ', location) when 1 then concat(title, ' in ', location, ' or remote') when 2 then concat('hybrid, ', title) else concat('  ', lower(title), ' roles remote, entry-level') end"""
_NAMES = [(k, t) for k, group in enumerate(I.SAME_ROLE) for t in group]
_KEY = "array_to_string(list_sort(list_distinct(list_filter({0}, lambda w: w not in {1}))), ' ')"


def _sql_found(rules) -> str:
    return "list_sort(list_filter([" + ", ".join(f"case when regexp_matches(low, '{p}') then '{n}' end" for p, n in rules) + "], lambda x: x is not null))"


def _sql_title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_split_to_array(trim({x}), '\\s+'), lambda w: case when w in ('ml', 'ai', 'bi', 'ui', 'ux', 'rn', 'sre', 'qa', 'it', 'hr', 'seo', 'etl') then upper(w) else upper(w[1]) || lower(w[2:]) end), ' ')"


@query(f"""with {P}, i as (select id, {_INTENT} as text from p), t as (select id, trim(text) as text, lower(trim(text)) as low from i),
    r as (select *, trim(regexp_replace(regexp_replace(regexp_split_to_array(low, '{I.ROLE_ENDS}')[1], '{I.NO_ROLE}', ' ', 'g'), '\\s+', ' ', 'g'), ' ,.-') as cut from t), u as (select *, case when cut = '' then low[1:60] else cut end as role from r),
    k as (select *, {_KEY.format(sql_tokens('role'), sql_in(NOISE))} as key from u),
    names(g, name) as (values {", ".join(f"({g}, '{t}')" for g, t in _NAMES)}), keyed as (select g, name, {_KEY.format(sql_tokens('name'), sql_in(NOISE))} as key from names),
    chosen as (select id, min(g) as g from k join keyed on role = name or k.key = keyed.key group by id), others as (select g, list(name order by name) as own from names group by g)
    select id, {_sql_title('role')} as title, coalesce(array_to_string(list_transform(list_filter(own, lambda x: x <> role), lambda x: {_sql_title('x')}), ','), '') as alternatives,
        array_to_string(list_transform(list_filter(list_concat(case when list_contains(string_split(role, ' '), 'engineer') then ['sales engineer', 'field service engineer'] else [] end, case when list_contains(string_split(role, ' '), 'analyst') then ['financial analyst'] else [] end,
            case when list_contains(string_split(role, ' '), 'developer') then ['business developer'] else [] end), lambda x: x <> role), lambda x: {_sql_title('x')}), ',') as excluded,
        array_to_string({_sql_found(I.LEVELS)}, ',') as seniority, array_to_string({_sql_found(I.WORKPLACES)}, ',') as workplace,
        case when trim(regexp_extract(text, '{I.PLACE.replace("'", "''")}', 1)) <> '' then trim(regexp_extract(text, '{I.PLACE.replace("'", "''")}', 1)) when regexp_matches(low, '\\bremote\\b') then 'Remote' else '' end as location
    from k left join chosen using (id) left join others using (g)""")
def planned_searches(spark, sf_dir):
    """Intents that people could have typed for the derived postings, and the plan of each."""
    intents = postings(spark, sf_dir).select("id", F.expr(_INTENT).alias("text"))
    listed = lambda c: F.array_join(f"plan.{c}", ",")
    found = I.planned(intents, "text")
    return found.select("id", "plan.title", listed("alt_titles").alias("alternatives"), listed("exclude_titles").alias("excluded"), listed("seniority").alias("seniority"), listed("workplace").alias("workplace"), "plan.location")


# --- edits and nested values ---------------------------------------------------------------------------------------------------

_PUT = "case when spot = 0 then regexp_replace({0}, '\\s+$', '') || chr(10) || '- ' || {1} || chr(10) when eol = 0 then {0} || chr(10) || '- ' || {1} else {0}[1:spot + length({2}) - 1 + eol - 1] || chr(10) || '- ' || {1} || {0}[spot + length({2}) + eol - 1:] end"


@query(rf"""with w as (select conv_id, turn, text, regexp_extract_all(text, '\S+') as w from conversations), a as (select *, w[2] as a1, w[3] as a2, w[1] as a3, coalesce(w[2], '') <> '' as there from w),
    b as (select *, case when there then text[1:instr(text, a1) - 1] || '[first] ' || conv_id || text[instr(text, a1) + length(a1):] else text end as t1 from a),
    c as (select *, coalesce(a2, '') <> '' and contains(t1, a2) as there2, case when there2 then t1[1:instr(t1, a2) - 1] || 'and' || t1[instr(t1, a2) + length(a2):] else t1 end as t2 from b),
    d as (select *, case when coalesce(a3, '') <> '' then instr(t2, a3) else 0 end as spot, case when spot = 0 then 0 else instr(t2[spot + length(a3):], chr(10)) end as eol from c),
    e as (select *, {_PUT.format("t2", "'turn ' || turn", "a3")} as t3, spot = 0 as lost3 from d)
    select conv_id, turn, regexp_replace(t3, '\s+$', '') || chr(10) || '- at the end' || chr(10) as text, array_to_string(list_filter([case when not there then 0 end, case when not there2 then 1 end, case when lost3 then 2 end, 3], lambda x: x is not null), ',') as missing from e""")
def edited_texts(spark, sf_dir):
    """Each turn with its second word and its third replaced, a line put behind the one of the first word, and one whose anchor no turn has."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    edit = lambda kind, anchor, new: F.struct(F.lit(kind).alias("kind"), anchor.alias("anchor"), new.alias("new"))
    edits = F.array(
        edit("replace", F.get(words, F.lit(1)), F.concat(F.lit("[first] "), F.col("conv_id").cast("string"))), edit("replace", F.get(words, F.lit(2)), F.lit(" and ")),
        edit("insert", F.get(words, F.lit(0)), F.concat(F.lit("turn "), F.col("turn").cast("string"))), edit("insert", F.lit("§ no such words §"), F.lit("at the end")),
    )
    return c.select("conv_id", "turn", D.edited(F.col("text"), edits).alias("e")).select("conv_id", "turn", "e.text", F.array_join(F.col("e.missing").cast("array<string>"), ",").alias("missing"))


_K = "cast(json_extract(props, '$.k') as bigint)"


@query(f"""select event_id, case when event_id % 3 <> 0 then {_K} end as k, user_id % 4 as depth, case when event_id % 2 = 0 then 'over' else 'base' end as name, cast({_K} + 1 as bigint) as kept, case when event_id % 3 = 1 then 2 end as added from events""")
def merged_settings(spark, sf_dir):
    """Settings of each event overlaid at three depths: a field replaced, one taken away, one added, one kept."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    base = F.to_json(F.struct("k", F.struct(F.lit("base").alias("name"), F.struct(F.lit(9).alias("depth"), (F.col("k") + 1).alias("kept")).alias("b")).alias("a")))
    depth = F.concat(F.lit('{"depth":'), (F.col("user_id") % 4).cast("string"), F.when(F.col("event_id") % 3 == 1, ',"added":2').otherwise(""), F.lit("}"))
    over = F.concat(F.lit('{"a":{'), F.when(F.col("event_id") % 2 == 0, '"name":"over",').otherwise(""), F.lit('"b":'), depth, F.lit("}"), F.when(F.col("event_id") % 3 == 0, ',"k":null').otherwise(""), F.lit("}"))
    told = e.select("event_id", J.merged_json(base, over).alias("j"))
    path = lambda p, kind: F.get_json_object("j", p).cast(kind)
    return told.select("event_id", path("$.k", "long").alias("k"), path("$.a.b.depth", "long").alias("depth"), path("$.a.name", "string").alias("name"), path("$.a.b.kept", "long").alias("kept"), path("$.a.b.added", "int").alias("added"))


@query(f"""select event_id, sha256('{{"a":' || user_id || ',"b":{{"k":' || {_K} || ',"t":"' || event_type || '"}}}}') as key, true as same from events""")
def canonical_keys(spark, sf_dir):
    """Keys of a request written with its fields in two orders."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    one = F.to_json(F.struct(F.struct(F.col("event_type").alias("t"), "k").alias("b"), F.col("user_id").alias("a")))
    two = F.concat(F.lit('{ "a": '), F.col("user_id").cast("string"), F.lit(', "b": {"k": '), F.col("k").cast("string"), F.lit(', "t": "'), "event_type", F.lit('"} }'))
    return e.select("event_id", J.canonical_key(one).alias("key"), (J.canonical_key(one) == J.canonical_key(two)).alias("same"))


# --- suites ----------------------------------------------------------------------------------------------------------------------


def _status(number: str) -> str:
    return f"case cast({number} % 3 as int) when 0 then 'met' when 1 then 'partial' else 'missing' end"


_JUDGED = f"""select l.doc_id as case_id, concat('r', cast(l.doc_id % 3 as varchar(9))) as requirement, {_status('n_chars')} as gold, l.doc_id % 7 <> 0 as assessed, {_status('(n_chars + l.doc_id % 2)')} as det, {_status('(n_chars + l.doc_id % 3)')} as raw,
    {_status('(n_chars + l.doc_id % 5)')} as final, l.doc_id % 5 <> 0 and l.doc_id % 4 <> 1 as verified, case when l.doc_id % 6 = 0 then '' else 'q' end as quote, l.doc_id % 4 <> 1 as quote_found, case when quality = 1 then 'apply' else 'skip' end as verdict, n_chars from labels l join documents d on d.doc_id = l.doc_id"""
_REPEATED = f"select case_id, requirement, assessed, case when case_id % 5 = 0 and run = 2 then 'missing' else raw end as raw, final, case when case_id % 9 = 0 and run = 1 then 'maybe' else verdict end as verdict from ({_JUDGED}) j, (select 0 as run union all select 1 union all select 2) runs where case_id % 11 <> 0 or run < 2"
_LINES = f"select n_chars % 4 as tp, case_id % 2 as fp, cast(case_id % 3 = 0 as int) as fn, 5 as model_items, case_id % 3 as dropped, case_id % 4 <> 0 as used, case when case_id % 5 = 0 then 'holdout' else 'dev' end as split from ({_JUDGED}) j"


def _loader(sql: str):
    def load(spark, sf_dir):
        told = sql.replace("from labels l join documents d", "from {labels} l join {documents} d")
        return spark.sql(told, labels=table(spark, sf_dir, "labels"), documents=table(spark, sf_dir, "documents"))

    return load


def suites() -> list[U.Suite]:
    return [U.verifier(_loader(_JUDGED), lambda df: df), U.consistency(_loader(_REPEATED), lambda df: df, 3), U.extractor(_loader(_LINES), lambda df: df)]


_CREDIT = "('met', 'partial')"


def _rate(hits: str, of: str) -> str:
    return f"round(count(*) filter (({of}) and ({hits})) / nullif(count(*) filter ({of}), 0), 4)"


def _rows(suite: str, metrics: dict[str, str], source: str) -> str:
    return f"select '{suite}' as suite, unnest([{', '.join(repr(m) for m in metrics)}]) as metric, unnest([{', '.join(f'({x})::double' for x in metrics.values())}]) as value from {source}"


_VERIFIER = {
    "gold_requirements": "count(*)", "gold_coverage": _rate("assessed", "true"), "rules_accuracy": _rate("det = gold", "assessed"), "raw_accuracy": _rate("raw = gold", "assessed"), "final_accuracy": _rate("final = gold", "assessed"),
    "hallucinated_quote_rate": _rate("not quote_found", f"assessed and raw in {_CREDIT} and quote <> ''"), "irrelevant_quote_rate": _rate("quote_found and not verified", f"assessed and raw in {_CREDIT} and quote <> ''"),
    "unquoted_claim_rate": _rate(f"raw in {_CREDIT} and quote = ''", "assessed"), "raw_overcredit_rate": _rate(f"raw in {_CREDIT}", "assessed and gold = 'missing'"), "final_overcredit_rate": _rate(f"final in {_CREDIT}", "assessed and gold = 'missing'"),
    "ai_added_false_credit": f"count(*) filter (assessed and gold = 'missing' and det = 'missing' and final in {_CREDIT})", "missed_credit_rate": _rate("final = 'missing'", "assessed and gold = 'met'"),
    "unsupported_quote_accepted": "count(*) filter (assessed and verified and not quote_found)", "ai_lift": f"round({_rate('final = gold', 'assessed')} - {_rate('det = gold', 'assessed')}, 4)",
} | {f"f1_{s}": f"round(2 * count(*) filter (assessed and final = '{s}' and gold = '{s}') / nullif(count(*) filter (assessed and final = '{s}') + count(*) filter (assessed and gold = '{s}'), 0), 4)" for s in U.STATUSES}
_F1 = "round(2.0 * ({0} / ({0} + {1})) * ({0} / ({0} + {2})) / ({0} / ({0} + {1}) + {0} / ({0} + {2})), 4)"
_EXTRACTOR = {
    "precision": "round(sum(tp) / (sum(tp) + sum(fp)), 4)", "recall": "round(sum(tp) / (sum(tp) + sum(fn)), 4)", "f1": _F1.format("sum(tp)", "sum(fp)", "sum(fn)"), "holdout_f1": _F1.format(*(f"sum({c}) filter (split = 'holdout')" for c in ("tp", "fp", "fn"))),
    "ungrounded_item_rate": "round(sum(dropped) / sum(model_items), 4)", "fallback_to_rules_rate": _rate("not used", "true"), "cases": "count(*)",
}
_CONSISTENCY = {"requirements": "count(*) filter (n = 3)", "raw_agreement": _rate("raws = 1", "n = 3"), "final_agreement": _rate("finals = 1", "n = 3"), "verdict_flip_rate": _rate("verdicts > 1", "true")}
SQL_SUITES = f"""j as ({_JUDGED}), runs_ as ({_REPEATED}), lines_ as ({_LINES}), g as (select case_id, requirement, count(*) filter (assessed) as n, count(distinct raw) filter (assessed) as raws, count(distinct final) filter (assessed) as finals, count(distinct verdict) as verdicts from runs_ group by all),
    report as ({_rows("deep_verifier", _VERIFIER, "j")} union all {_rows("extractor", _EXTRACTOR, "lines_")} union all {_rows("consistency", _CONSISTENCY, "g")} union all select 'consistency', 'repeats', 3)"""


def reports(spark, sf_dir):
    out = None
    for suite in suites():
        told = U.reported(suite, spark, sf_dir)
        out = told if out is None else out.unionByName(told)
    return out


@query(f"with {SQL_SUITES} select * from report")
def suite_reports(spark, sf_dir):
    """Three suites over judgments made of labels and documents."""
    return reports(spark, sf_dir)


@query(f"""with {SQL_SUITES} select suite, '## ' || suite || chr(10) || chr(10) || '| metric | value |' || chr(10) || '|-|-|' || chr(10) || string_agg('| ' || metric || ' | ' || coalesce(regexp_replace(regexp_replace(printf('%.4f', value), '0+$', ''), '\\.$', ''), 'n/a') || ' |', chr(10) order by metric) || chr(10) as text from report group by suite""")
def suite_tables(spark, sf_dir):
    """The same as Markdown."""
    return U.as_markdown(reports(spark, sf_dir))


# --- ages ------------------------------------------------------------------------------------------------------------------------

AS_OF = "1997-06-01 00:00:00"


@query(f"""with {P}, a as (select (epoch(timestamp '{AS_OF}') - epoch(posted)) / 86400.0 as days from p) select case when days is null then 'date unknown' when days <= 1 then '≤ 1 day' when days <= 7 then '≤ 1 week' when days <= 31 then '≤ 1 month' else 'older' end as recency, count(*) as n from a group by 1""")
def recency_of_postings(spark, sf_dir):
    """Postings by age at a day amid them: a day, a week, a month, older, unknown."""
    return postings(spark, sf_dir).groupBy(recency(age_hours(F.col("posted"), AS_OF)).alias("recency")).agg(F.count("*").alias("n"))


# --- calibrated scores, insights, projects, the board ---------------------------------------------------------------------------

CURVE = Calibration(-2.5, (("skills", 2.0), ("requirements", 1.5), ("role", 1.0), ("experience", 0.5), ("semantic", 0.25)), 300)


@query(f"""with {SQL_SCORES} select id, cast(round_even(round(greatest(0.0, least(1.0, case when short then least(u, 0.45) else u end)) * 100, 9), 0) as int) as score
    from (select *, 1 / (1 + exp(-(-2.5 + 2.0 * skills + 1.5 * requirements + 1.0 * role + 0.5 * experience + 0.25 * semantic))) - penalty as u from parts)""")
def calibrated_scores(spark, sf_dir):
    """Scores by a logistic curve over the components."""
    parts = {k: F.col(k) for k in FEATURES}
    return all_scores(spark, sf_dir).select("id", M.total_score(parts, F.col("penalty"), F.col("capped"), CURVE).alias("score"))


@query(f"""with {SQL_SCORES}, d as (select skill, count(*) as n, count(*) filter (credit < 1) as gap from weights group by skill), t as (select count(*) as n from p),
    gaps as (select skill, gap as jobs, cast(round_even(100 * gap / (select n from t), 0) as int) as pct, row_number() over (order by gap desc, skill) as k from d where gap > 0 qualify k <= 6),
    strong as (select skill, cast(round_even(100 * (n - gap) / (select n from t), 0) as int) as pct, row_number() over (order by n - gap desc, skill) as k from d where skill in {_OWNED} and n > gap qualify k <= 5),
    best as (select title, company, score from scores join (select id, title from p) using (id) order by score desc, title, company limit 1), facts as (select count(*) as n, count(*) filter (years is not null and years <> 0 and round_even(experience * 100, 0) < 70) as short_n,
        count(*) filter (round_even(role * 100, 0) < 40) as weak, count(*) filter (short or (skills = 0 and matched = '' and missing = '' and n_lines = 0 and length(description) < 200)) as low from scores),
    good as (select 0 as part, k, skill || ' is requested in ' || pct || '% of these postings and it''s on your resume.' as text from strong union all select 1, 1, 'About 4 years of experience detected on your resume.'
        union all select 2, 1, 'Strongest fit: ' || title || ' at ' || company || ' (' || score || '%).' from best where score >= 60),
    better as (select 0 as part, 'Close the most frequent skill gaps: ' || string_agg(skill, ', ' order by k) || '.' as text from gaps where k <= 5 having count(*) > 0
        union all select 1, short_n || ' postings ask for more experience than your resume shows — make dates and scope of past roles explicit, and quantify impact.' from facts where short_n > 0
        union all select 2, 'Your resume rarely mentions the role words from ''data'' postings — add a headline/summary that names the target role.' from facts where weak > n / 2
        union all select 3, low || ' postings had too little text to score reliably; treat their scores as rough.' from facts where low > 0
        union all select 4, 'Skills on your resume that these postings don''t ask for: ' || string_agg(skill, ', ' order by skill) || '. Keep them only if relevant to your target roles.' from (values ('MySQL'), ('Python'), ('SQL'), ('Spark')) o(skill) where skill not in (select skill from weights) having count(*) > 0)
    select 'strength' as kind, cast(row_number() over (order by part, k) as int) as place, null as skill, text from good union all select 'improvement', cast(row_number() over (order by part) as int), null, text from better
    union all select 'skill', cast(k as int), skill, 'Missing from your resume but mentioned in ' || pct || '% of postings (' || jobs || ' of ' || (select n from t) || ').' from gaps""")
def report_insights(spark, sf_dir):
    """What the report of all postings says in sentences."""
    return insights(all_scores(spark, sf_dir), PROFILE, "data")


_CV = """concat('Jane Doe', chr(10), 'Projects', chr(10), 'Project ', cast(c_custkey as varchar(20)), chr(10), '• Built it in Python', chr(10), case when c_custkey % 2 = 0 then concat('• Used by ', cast(c_nationkey as varchar(20)), ' teams', chr(10), 'Second project', chr(10)) else '' end, '• Last point', chr(10),
    'Education', chr(10), 'MSc in ', case cast(c_custkey % 3 as int) when 0 then 'Physics' when 1 then 'Data Science & AI' else 'law' end, ', Rome University, 1998 - 2003', chr(10), 'Certifications', chr(10), case when c_custkey % 5 = 0 then concat('Certified ', cast(c_nationkey as varchar(20)), chr(10)) else '' end, '• Scrum Master')"""


def cvs(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as id", f"{_CV} as text")


@query("""select c_custkey as id, 'p1' as project, 'Project ' || c_custkey as name, case when c_custkey % 2 = 0 then 'Built it in Python|Used by ' || c_nationkey || ' teams' else 'Built it in Python|Last point' end as bullets from customer union all select c_custkey, 'p2', 'Second project', 'Last point' from customer where c_custkey % 2 = 0""")
def resume_projects(spark, sf_dir):
    return R.projects(cvs(spark, sf_dir)).select("id", "project", "name", F.array_join("bullets", "|").alias("bullets"))


@query("select c_custkey as id, 'Master''s' as degree, case c_custkey % 3 when 0 then 'Physics' when 1 then 'Data Science & AI' else '' end as field from customer")
def resume_fields(spark, sf_dir):
    return R.fields_of_study(cvs(spark, sf_dir)).select("id", "degree", "field")


@query("select c_custkey as id, 1 as n, 'Certified ' || c_nationkey as text from customer where c_custkey % 5 = 0 union all select c_custkey, case when c_custkey % 5 = 0 then 2 else 1 end, 'Scrum Master' from customer")
def resume_certificates(spark, sf_dir):
    return R.certifications(cvs(spark, sf_dir))


@query(f"""with r as ({_RUNS}), n as (select *, row_number() over (partition by suite, model order by created_at desc, run_id desc) as n from r), b as (select suite, model, case when run_id % 4 <> 0 then quality end as quality from n where n = 1)
    select suite, model, row_number() over (order by suite, coalesce(quality, -1) desc, model) as place from b""")
def board_places(spark, sf_dir):
    """The leaderboard as it is shown, some qualities unknown."""
    some = runs(spark, sf_dir)
    return E.board_order(E.leaderboard(some.withColumn("quality", F.when(F.col("run_id") % 4 != 0, F.col("quality"))))).select("suite", "model", "place")


@query("with n as (select event_id, user_id, row_number() over (partition by user_id order by ts desc, event_id) as n from events where ts > timestamp '2024-01-10') select event_id, user_id from n where n <= 20")
def kept_for_owners(spark, sf_dir):
    """Of each owner's unexpired rows the newest."""
    e = table(spark, sf_dir, "events").withColumn("expires_at", F.col("ts"))
    return records.newest_of_each(e, "user_id", "2024-01-10", 20, "ts", "event_id").select("event_id", "user_id")


# --- postings that aren't fetched -------------------------------------------------------------------------------------------------


@query("select 'manual-' || row_number() over (order by p_partkey desc) as id, trim(p_name) as title, p_brand as company, '' as location from part")
def manual_postings(spark, sf_dir):
    """Parts typed in as postings, the last one first."""
    typed = table(spark, sf_dir, "part").select((-F.col("p_partkey")).alias("pos"), F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("title"), F.col("p_brand").alias("company"), F.lit(None).cast("string").alias("location"), F.lit("").alias("url"), F.lit("").alias("description"))
    return entries.manual(typed).select("id", "title", "company", "location")


@query(f"""with {sql_tagged()} select id, relevance, row_number() over (order by relevance desc, id) as place from r where relevance >= 0.5""")
def sample_postings(spark, sf_dir):
    """Of the derived postings as samples those that fit the title."""
    return entries.samples(postings(spark, sf_dir), WANTED.title).select("id", "relevance", "place")


@query(f"""with {sql_tagged()} select id, employment_type from tagged where source = 'linkedin' and "drop" is null""")
def carded_postings(spark, sf_dir):
    """Cards without kinds of employment, which only their details tell and the filters then look at."""
    p = postings(spark, sf_dir).where("source = 'linkedin'")
    return entries.carded(p.drop("description", "employment_type"), p.select("id", "description", "employment_type"), WANTED).select("id", "employment_type")
