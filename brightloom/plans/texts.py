"""Registered queries on phrases, quotes, embeddings, costs and pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phrases as W
from ..functions.values import ROLE_WORD
from ..operators import claims as C
from ..operators import embedding as V2
from ..operators import evidence as V
from ..operators import pages as G
from ..operators import skills as S
from .postings import NOW, postings
from .queries import P, query, table
from .scoring import SQL_SCORES, TAX, all_scores

_ACCENTS = "translate(lower(source), 'é', 'e')"


@query(r"""with n as (select distinct company, trim(regexp_replace(regexp_replace(lower(company), '\b(inc|llc|ltd|limited|gmbh|corp|corporation|co|plc|sa|ag|bv|the)\b\.?', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) as n from p)
    select company, n as words, replace(n, ' ', '') || ',' || replace(n, ' ', '-') || ',' || string_split(n, ' ')[1] || ',' || replace(n, ' ', '') || 'inc,' || replace(n, ' ', '') || 'hq' as slugs from n""".replace("with n", f"with {P}, n"))
def company_slugs(spark, sf_dir):
    names = postings(spark, sf_dir).select("company").distinct()
    return names.select("company", W.company_words(F.col("company")).alias("words"), F.array_join(W.slug_candidates(F.col("company")), ",").alias("slugs"))


@query(f"with {P} select id, coalesce(nullif(trim(regexp_split_to_array(location, '[,(;|]')[1]), ''), 'Unspecified') as city from p")
def display_cities(spark, sf_dir):
    return postings(spark, sf_dir).select("id", W.city_of(F.col("location")).alias("city"))


@query("""select conv_id, turn, case when length(text) > 40 then substr(text, 1, 40) || chr(10) || '…[truncated]' else text end as cut, regexp_replace(lower(text), '\\s+', ' ', 'g') as plain,
    regexp_replace(role || ' ' || text, '[^A-Za-z0-9._-]+', '-', 'g') as slug, replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), ' ') as label from conversations""")
def conversation_phrases(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", W.trimmed(F.col("text"), 40).alias("cut"), W.squeezed(F.col("text")).alias("plain"), W.file_slug(F.concat_ws(" ", "role", "text")).alias("slug"), W.label_value(F.col("text")).alias("label"))


_TITLED = "array_to_string(list_transform(regexp_split_to_array(trim({0}), '\\s+'), lambda w: case when w in ('ml', 'ai', 'bi', 'ui', 'ux', 'rn', 'sre', 'qa', 'it', 'hr', 'seo', 'etl') then upper(w) else upper(w[1]) || lower(w[2:]) end), ' ')"


@query(f"""with t as (select conv_id, turn, left(text, 30) || ' sk-abc_' || (10000 + conv_id) || ' cvx_' || turn || ' and cvx_abcdef' || turn || '. sk-12345' as text, role || '  etl of ml BI turn' || turn as name from conversations)
    select conv_id, turn, regexp_replace(text, '\\b(sk-[A-Za-z0-9_-]{{6,}}|cvx_[A-Za-z0-9_-]{{6,}})', '***', 'g') as masked, {_TITLED.format("name")} as titled from t""")
def masked_and_titled(spark, sf_dir):
    """Turns with keys planted in them, and labels made of their roles."""
    c = table(spark, sf_dir, "conversations")
    turn = F.col("turn").cast("string")
    text = F.concat(F.substring("text", 1, 30), F.lit(" sk-abc_"), (F.col("conv_id") + 10000).cast("string"), F.lit(" cvx_"), turn, F.lit(" and cvx_abcdef"), turn, F.lit(". sk-12345"))
    return c.select("conv_id", "turn", W.masked(text).alias("masked"), W.title_case(F.concat("role", F.lit("  etl of ml BI turn"), turn)).alias("titled"))


_HEADER = "case cast(cast(substr(id, 3, 20) as bigint) % 4 as int) when 0 then concat(title, ' | ', company) when 1 then concat(company, ', ', title) when 2 then concat(title, ' at ', company) else company end"


@query(f"""with {P}, h as (select id, list_filter(list_transform(regexp_split_to_array({_HEADER}, '(?i)\\s+(?:[|·•–—@]|-|at)\\s+|,\\s*'), lambda x: trim(x, ' ,|-–—')), lambda x: x <> '') as parts from p),
    t as (select id, coalesce(parts[1], '') as a, coalesce(parts[2], '') as b from h), s as (select *, regexp_matches(b, '{ROLE_WORD}') and not regexp_matches(a, '{ROLE_WORD}') as swap from t)
    select id, case when swap then b else a end as title, case when swap then a else b end as company from s""")
def role_headers(spark, sf_dir):
    """Headings of roles made of the derived postings in four forms."""
    return postings(spark, sf_dir).select("id", W.header_parts(F.expr(_HEADER)).alias("h")).select("id", "h.title", "h.company")


@query(f"""with {P} select id, case when posted is null then null when d < 1 then 'today' when d < 30 then d || 'd' when d < 365 then d // 30 || 'mo' else d // 365 || 'y' end as age, month from
    (select *, cast(floor((epoch(timestamp '{NOW}') - epoch(posted)) / 86400) as int) as d, strftime(posted, '%Y-%m') as month from p)""")
def relative_ages(spark, sf_dir):
    index = F.year("posted") * 12 + F.month("posted") - 1
    return postings(spark, sf_dir).select("id", W.relative_age(F.col("posted"), F.lit(NOW)).alias("age"), F.when(F.col("posted").isNotNull(), W.month_label(index)).alias("month"))


@query("select event_id, case when user_id % 2 = 0 then ts + interval 365 day else ts + interval 7 day end as expires_at from events")
def expiries(spark, sf_dir):
    owner = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("u:"), "user_id")).otherwise(F.concat(F.lit("a:"), "user_id"))
    return table(spark, sf_dir, "events").select("event_id", W.expiry(owner, F.col("ts")).alias("expires_at"))


@query("""select event_id, round((user_id * 10 * 3.0 + event_id % 100 * 15.0) / 1e6, 6) as cost, least(5, greatest(1, user_id % 9)) as grade,
    round(round(((user_id * 40 // 4) * 3.0 + 50 * 15.0 + (user_id * 4 // 4) * 3.75) / 1e6, 6) + round((((user_id * 40 - user_id * 4) // 4) * 3.0 + 50 * 15.0 + (user_id * 4 // 4) * 0.3) / 1e6, 6) * 4, 4) as estimate from events""")
def call_costs(spark, sf_dir):
    prices = F.struct(F.lit(3.0).alias("inp"), F.lit(15.0).alias("out"), F.lit(0.3).alias("read"), F.lit(3.75).alias("written"))
    user, zero = F.col("user_id"), F.lit(0)
    return table(spark, sf_dir, "events").select(
        "event_id", W.cost_usd(prices, user * 10, F.col("event_id") % 100, zero, zero).alias("cost"), W.clamped((user % 9), 1, 5).alias("grade"), W.estimated_cost(prices, user * 40, F.lit(50), F.lit(5), user * 4).alias("estimate")
    )


_BEFORE = "(select c.conv_id, c.turn, c.text, b.text as other from conversations c join conversations b on b.conv_id = c.conv_id and b.turn = c.turn - 1)"


@query(f"""with j as {_BEFORE}, w as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9+#]+')) as a, list_distinct(regexp_extract_all(lower(other), '[a-z0-9+#]+')) as b, regexp_extract_all(lower(text), '[a-z'']+') as o, regexp_extract_all(lower(other), '[a-z'']+') as i from j)
    select conv_id, turn, round(case when len(list_distinct(list_concat(a, b))) = 0 then 1 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 9) as jaccard, round(len(list_intersect(a, b)) / nullif(len(a), 0), 9) as containment,
        len(list_filter(range(1, len(i) - 1), lambda k: contains(array_to_string(o, ' '), array_to_string(i[k:k + 2], ' ')))) > 0 as echoes from w""")
def turn_likeness(spark, sf_dir):
    """Each turn against the one before it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    met = c.join(c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("other")), ["conv_id", "turn"])
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9+#]+"), F.lit(0)))
    a, b = words(F.col("text")), words(F.col("other"))
    return met.select("conv_id", "turn", F.round(W.jaccard(a, b), 9).alias("jaccard"), F.round(W.containment(a, b), 9).alias("containment"), W.echoes(F.col("text"), F.col("other"), 3).alias("echoes"))


@query(r"""with w as (select doc_id, list_filter(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9+#\-]{1,}'), lambda x: trim(x, '-')), lambda x: length(x) >= 3) as w from documents),
    s as (select doc_id, unnest(w) as w from w), k as (select doc_id, w, coalesce(list_filter(['ations', 'ation', 'ments', 'ment', 'ings', 'ing', 'ers', 'er', 'ies', 'es', 'ed', 's'], lambda e: ends_with(w, e) and length(w) - length(e) >= 3)[1], '') as e from s
        where w not in (""" + ", ".join(f"'{w}'" for w in W.LOW_INFORMATION) + ") and w not in (" + ", ".join("'" + w.replace("'", "''") + "'" for w in W.STOP) + r"""))
    select doc_id, count(distinct substr(substr(w, 1, length(w) - length(e)), 1, 5)) as stems from k group by doc_id""")
def document_stems(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(W.evidence_stems(F.col("text"))).cast("long").alias("stems"))
    return d.where("stems > 0")


@query()
def hashed_embeddings(spark, sf_dir):
    """Each conversation's turn and its likeness to the turn before it; BLAKE2 isn't in SQL, so tests hold it against plain Python."""
    by = V2.embedder("hash")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", V2.embedded(F.col("text"), by).alias("v"))
    met = c.join(c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("v").alias("u")), ["conv_id", "turn"])
    sim = W.cosine(F.col("v"), F.col("u"))
    return met.select("conv_id", "turn", F.round(sim, 6).alias("cosine"), F.round(by.credit(sim), 6).alias("credit"))


# --- quotes ----------------------------------------------------------------------------------------------------------------

_QUOTE = "select o_orderkey as id, case cast(o_orderkey % 4 as int) when 0 then p_name when 1 then concat(p_name, ' shipped daily in crates') when 2 then concat('about ', p_type) else 'no' end as quote, concat('Worked on ', p_name, ' and ', p_type, ' shipped daily') as resume from orders join (select l_orderkey, min(l_partkey) as l_partkey from lineitem group by l_orderkey) x on l_orderkey = o_orderkey join part on p_partkey = l_partkey"
_PLAIN = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9+#%$.]+', ' ', 'g'), '\s+', ' ', 'g'))"


def quotes(spark, sf_dir):
    tables = {t: table(spark, sf_dir, t) for t in ("orders", "lineitem", "part")}
    sql = _QUOTE.replace("from orders", "from {orders}").replace("from lineitem", "from {lineitem}").replace("join part ", "join {part} ")
    return spark.sql(sql, **tables)


@query(f"""with q as ({_QUOTE}), n as (select id, {_PLAIN.format('quote')} as q, {_PLAIN.format('resume')} as r from q), w as (select *, string_split(q, ' ') as w from n)
    select id, case when length(q) < 4 then false when contains(r, q) then true when len(w) < 5 then false else len(list_filter(w, lambda x: list_contains(string_split(r, ' '), x))) / len(w) >= 0.85
        and len(list_filter(range(1, len(w) - 3), lambda k: contains(r, array_to_string(w[k:k + 4], ' ')))) > 0 end as found from w""")
def quotes_found(spark, sf_dir):
    return quotes(spark, sf_dir).select("id", V.stands_in(F.col("quote"), F.col("resume")).alias("found"))


def sql_stems(text: str) -> str:
    """Distinct stems of a text, as a list."""
    words = f"list_filter(list_transform(regexp_extract_all(lower({text}), '[a-z][a-z0-9+#\\-]{{1,}}'), lambda x: trim(x, '-')), lambda x: length(x) >= 3 and x not in (" + ", ".join(f"'{w}'" for w in W.LOW_INFORMATION) + ") and x not in (" + ", ".join("'" + w.replace("'", "''") + "'" for w in W.STOP) + "))"
    return f"list_distinct(list_transform({words}, lambda w: w[1:length(w) - length(coalesce(list_filter(['ations', 'ation', 'ments', 'ment', 'ings', 'ing', 'ers', 'er', 'ies', 'es', 'ed', 's'], lambda e: ends_with(w, e) and length(w) - length(e) >= 3)[1], ''))][1:5]))"


_CASE = "case cast(id % 3 as int) when 0 then concat('Handling ', resume) when 1 then 'Painting houses' else '5+ years of experience' end as requirement, case cast(id % 5 as int) when 0 then 'partial' when 1 then 'odd' when 2 then 'missing' else 'met' end as said"


@query(f"""with q as (select *, {_CASE} from ({_QUOTE})), n as (select id, said, quote, {_PLAIN.format('quote')} as q, {_PLAIN.format('resume')} as r, {sql_stems('quote')} as own, {sql_stems('requirement')} as asked from q), w as (select *, string_split(q, ' ') as w from n),
    f as (select *, case when length(q) < 4 then false when contains(r, q) then true when len(w) < 5 then false else len(list_filter(w, lambda x: list_contains(string_split(r, ' '), x))) / len(w) >= 0.85
        and len(list_filter(range(1, len(w) - 3), lambda k: contains(r, array_to_string(w[k:k + 4], ' ')))) > 0 end as found, len(asked) > 0 and len(list_intersect(asked, own)) >= least(greatest(1, (len(asked) + 1) // 2), len(asked)) as bears from w),
    c as (select *, case when said = 'odd' then 'missing' else said end as known, said in ('met', 'partial') as claims from f)
    select id, case when claims and not (found and bears) then case when known = 'met' then 'partial' else 'missing' end else known end as status, claims and found and bears as verified,
        case when not claims or (found and bears) then '' when not found then 'quote not found in the resume' else 'quote doesn''t relate to the requirement' end as flag from c""")
def judged_claims(spark, sf_dir):
    """What was said of each order's requirement, with a quote that may be made up or beside the point."""
    rows = quotes(spark, sf_dir).selectExpr("*", *_CASE.replace(" as requirement, ", " as requirement|").split("|"))
    skills = lambda c: S.wanted_of(S.hits_in(S.words_of(F.col(c)), TAX))
    rows = rows.withColumns({"qs": skills("quote"), "rs": skills("requirement")})
    found = (F.col("quote") != "") & V.stands_in(F.col("quote"), F.col("resume"))
    j = V.judged(F.col("said"), F.col("quote"), found, V.bears_on(F.col("quote"), F.col("requirement"), F.col("qs"), F.col("rs")))
    return rows.select("id", j.alias("j")).select("id", "j.status", "j.verified", "j.flag")


_SMALL = "('a', 'an', 'the', 'and', 'or', 'of', 'in', 'to', 'with', 'for')"


@query(f"""with {P}, c as (select id, 'Experience with Python and ' || string_split(title, ' ')[1] as line, description, title from p), u as (select id, line, title, description, unnest(string_split(description, chr(10))) as unit from c),
    t as (select *, list_distinct(list_filter(regexp_extract_all(lower(line), '[a-z0-9+#]+'), lambda w: w not in {_SMALL})) as a, list_distinct(list_filter(regexp_extract_all(lower(unit), '[a-z0-9+#]+'), lambda w: w not in {_SMALL})) as b from u)
    select id, bool_or(len(list_intersect(a, b)) / len(a) >= 0.75 or len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.6) as verified, substr(sha256(any_value(title) || chr(10) || any_value(description)), 1, 16) as fingerprint from t group by id""")
def verified_spans(spark, sf_dir):
    p = postings(spark, sf_dir).withColumn("line", F.concat(F.lit("Experience with Python and "), F.element_at(F.split("title", " "), 1)))
    return p.select("id", V.span_verified(F.col("line"), F.col("description"), F.array().cast("array<string>")).alias("verified"), V.fingerprint(F.col("title"), F.col("description")).alias("fingerprint"))


@query(f"""with {SQL_SCORES}, n as (select id, text, preferred, coverage, case when coverage >= 0.75 then 'met' when coverage >= 0.35 then 'partial' else 'missing' end as status from covered where coverage is not null),
    f as (select id, sum(case when preferred then 0.5 else 1.0 end * case when text = 'SQL and Airflow' then 0.5 else coverage end) / sum(case when preferred then 0.5 else 1.0 end) as req, count(*) filter (text = 'SQL and Airflow') as verified,
        count(*) filter (text = 'SQL and Airflow' and status <> 'partial') as disagreements from n group by id)
    select id, score as det_score, cast(round_even(round(greatest(0.0, least(1.0, 0.40::double * round_even(skills * 100, 0) / 100 + 0.20::double * coalesce(req, round_even(requirements * 100, 0) / 100) + 0.15::double * round_even(role * 100, 0) / 100
        + 0.15::double * round_even(experience * 100, 0) / 100 + 0.10::double * round_even(semantic * 100, 0) / 100 - penalty)) * 100, 9), 0) as int) as final_score, coalesce(verified, 0) as verified, coalesce(disagreements, 0) as disagreements from scores left join f using (id)""")
def combined_scores(spark, sf_dir):
    """Every posting's line `SQL and Airflow` is judged to be half met."""
    scores = all_scores(spark, sf_dir)
    told = postings(spark, sf_dir).select("id", F.lit("SQL and Airflow").alias("text"), F.lit("partial").alias("status"), F.lit(True).alias("verified"))
    return V.combined(scores, told).select("id", "det_score", "final_score", "verified", "disagreements")


# --- pages -----------------------------------------------------------------------------------------------------------------


@query(f"""with {P}, s as (select id, case salary when '' then '' else salary end as said from p) select id, case when said like '$%k - %' then said when said like '£%' then said when said like '$55%' then said when said like '€%' then said else '' end as salary from s""")
def stated_salaries(spark, sf_dir):
    return postings(spark, sf_dir).select("id", G.salary_from_text(F.concat(F.lit("Pay: "), "salary", F.lit(" for this job; a $5 card"))).alias("salary"))


@query(f"""with {P} select 'https://jobs.example.com/' || id as url, true as ok, title, company, coalesce(nullif(location, ''), '') as location, 'We ship ' || title as description, lower(replace(upper(replace(employment_type, '-', '_')), '_', ' ')) as employment_type,
    case when cast(substr(id, 3) as bigint) % 2 = 0 then '50–70 EUR HOUR' else '' end as salary from p""")
def page_postings(spark, sf_dir):
    """Pages of linked data made of the derived postings, within a graph, and read as pages."""
    p = postings(spark, sf_dir)
    pay = F.when(F.substring("id", 3, 20).cast("long") % 2 == 0, F.expr("named_struct('currency', 'EUR', 'value', named_struct('minValue', 50, 'maxValue', 70, 'unitText', 'HOUR'))"))
    node = F.struct(
        F.lit("JobPosting").alias("@type"), F.col("title"), F.struct(F.col("company").alias("name")).alias("hiringOrganization"), F.struct(F.struct(F.col("location").alias("addressLocality")).alias("address")).alias("jobLocation"),
        F.concat(F.lit("<p>We ship "), "title", F.lit("</p>")).alias("description"), F.upper(F.replace("employment_type", F.lit("-"), F.lit("_"))).alias("employmentType"), pay.alias("baseSalary"),
    )
    graph = F.to_json(F.struct(F.array(node).alias("@graph")))
    html = F.concat(F.lit('<html><head><script type="application/ld+json">'), graph, F.lit("</script></head><body>x</body></html>"))
    found = G.page_postings(p.select(F.concat(F.lit("https://jobs.example.com/"), "id").alias("url"), html.alias("html")))
    return found.select("url", "ok", "title", "company", "location", "description", "employment_type", "salary")


@query("""with t as (select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, regexp_extract(html, '(?is)<article\\b[^>]*>(.*)</article>', 1) as a, regexp_extract(html, '(?is)<main\\b[^>]*>(.*)</main>', 1) as m from pages)
    select count(*) as pages, count(*) filter (title <> '' and (a <> '' or m <> '')) as readable from t""")
def readable_pages(spark, sf_dir):
    """How many pages have a title and main text to fall back on."""
    p = table(spark, sf_dir, "pages")
    main = F.col("html").rlike(r"(?is)<(main|article)\b[^>]*>.*</\1>")
    return p.agg(F.count("*").alias("pages"), F.count_if(main & (F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)) != "")).alias("readable"))


@query("""select page_id, case when not regexp_matches(url, '^https?://[^/:?#]*[.]') then 'not a public web link' when regexp_matches(url, '^https?://([^/:?#]*[.])?(localhost|local|internal)([:/?#]|$)') then 'not a public website' end as reason from pages""")
def rejected_addresses(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", G.rejected(F.col("url")).alias("reason"))


@query(f"""with {P} select substr(id, 3) || '000000' as id, title, company, case location when '' then '' else location end as location, 'https://www.example.com/jobs/view/' || substr(id, 3) || '000000' as url, '2024-05-01' as posted from p""")
def result_cards(spark, sf_dir):
    """Cards made of the derived postings, twenty or so on a page, and read again."""
    number = F.concat(F.substring("id", 3, 20), F.lit("000000"))
    card = F.concat(
        F.lit('<li><div class="base-card" data-entity-urn="urn:li:jobPosting:'), number, F.lit('"><a class="base-card__full-link" href="https://www.example.com/jobs/view/'), number, F.lit('?x=1">go</a><h3 class="base-search-card__title"> '),
        F.col("title"), F.lit(' </h3><h4 class="base-search-card__subtitle">'), F.col("company"), F.lit('</h4><span class="job-search-card__location">'), F.col("location"), F.lit('</span><time datetime="2024-05-01">now</time></div></li>'),
    )
    pages = postings(spark, sf_dir).groupBy(F.pmod(F.xxhash64("id"), F.lit(64)).alias("page")).agg(F.array_join(F.collect_list(card), "\n").alias("html"))
    return G.cards(pages)


# --- claims ----------------------------------------------------------------------------------------------------------------

_WRITTEN = """o_orderkey as id, concat('Built ', case cast(o_orderkey % 3 as int) when 0 then 'Kafka' when 1 then 'Python' else 'SQL' end, ' jobs at Acme ', case cast(o_custkey % 2 as int) when 0 then 'Analytics' else 'Works' end, case when o_orderkey % 5 = 0 then ' as a senior' else '' end,
    case when o_orderkey % 7 = 0 then ', saving 30%' else '' end, case when o_orderkey % 11 = 0 then ' since 2021' else '' end, case when o_orderkey % 13 = 0 then ' with a PhD' else '' end) as new, case when o_custkey % 3 = 0 then 'Cut cost by 30% at Acme Works' else 'Work of 2020 at Acme' end as source"""


@query("""select o_orderkey as id, concat_ws(',', case when o_orderkey % 3 = 0 then 'skill Kafka' end, case when o_orderkey % 7 = 0 and o_custkey % 3 <> 0 then 'number 30%' end, case when o_orderkey % 11 = 0 then 'year 2021' end, case when o_orderkey % 13 = 0 then 'degree degree' end,
    case when o_orderkey % 5 = 0 then 'title senior' end, case when o_custkey % 2 = 0 then 'name Acme Analytics' when o_custkey % 3 <> 0 then 'name Acme Works' end, case when o_orderkey % 13 = 0 then 'name PhD' end) as found from orders""")
def verified_claims(spark, sf_dir):
    """Rewritten lines that may claim a skill, number, year, degree, title or name beyond what they were made of."""
    rows = table(spark, sf_dir, "orders").selectExpr(*_WRITTEN.replace(", concat('Built", "|concat('Built").replace(" as new, ", " as new|").split("|"))
    found = C.verified_claim(F.col("new"), F.lit("Python and SQL"), F.col("source"), F.lit(""), TAX)
    return rows.select("id", F.array_join(F.transform(found, lambda v: F.concat_ws(" ", v["kind"], v["value"])), ",").alias("found"))


@query("""select event_id, case when value::int % 2 = 0 then '' else (event_id % 50 + 100) || '%' end as strange from events""".replace("value::int", "user_id"))
def supported_numbers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    answer = F.concat(F.lit("1. It rose by "), (F.col("event_id") % 50 + 100).cast("string"), F.lit("%"))
    evidence = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("rise: "), (F.col("event_id") % 50 + 100).cast("string"))).otherwise("rise: 7")
    return e.select("event_id", F.array_join(C.numbers_supported(answer, evidence), ",").alias("strange"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, event_id % 3 <> 0 as ok from events where event_id % 3 <> 0 union all select event_id, null, false from events where event_id % 3 = 0")
def loose_json(spark, sf_dir):
    """JSON out of an answer's prose; a cut one is none."""
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure: "), F.substring("props", 1, 4))).otherwise(F.concat(F.lit("Sure: "), "props", F.lit(" I hope.")))
    told = table(spark, sf_dir, "events").select("event_id", C.loose_json(said).alias("j"))
    return told.select("event_id", F.get_json_object("j", "$.k").cast("long").alias("k"), F.col("j").isNotNull().alias("ok"))
