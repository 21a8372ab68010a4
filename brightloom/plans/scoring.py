"""Registered queries on skills, requirement lines, scores and reports over the derived postings, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..durable import kept, of_each_text
from ..operators import gates as G
from ..operators import matching as M
from ..operators import requirements as Q
from ..operators import skills as S
from .postings import POSTINGS, TABLES, postings
from .queries import P, query, rows, table, values

#: skill, category, alias, words of which one must stand near.
TAXONOMY = [
    ("Python", "Languages", "python", None), ("SQL", "Languages", "sql", None), ("Airflow", "Data", "airflow", None), ("Spark", "Data", "apache spark", None), ("Spark", "Data", "pyspark", None),
    ("Spark", "Data", "spark", ["pipelines", "data", "scala"]), ("Kafka", "Data", "kafka", None), ("Kinesis", "Data", "kinesis", None), ("Java", "Languages", "java", None), ("Docker", "Platform", "docker", None),
    ("Node.js", "Web", "node.js", None), ("CI/CD", "Platform", "ci/cd", None), ("IAM", "Security", "identity and access management", None), ("Communication", "Professional Skills", "communication", None),
    ("Collaboration", "Professional Skills", "teamwork", None), ("Ruby", "Languages", "ruby", ["rails", "gem"]), ("Rails", "Web", "rails", ["ruby", "rspec"]), ("Spring", "Web", "spring", ["java", "boot"]),
]
IMPLIES = [("MySQL", "SQL"), ("Spark", "Data engineering"), ("PySpark", "Spark"), ("Data engineering", "ETL"), ("Kubernetes", "Docker")]
RELATED = [("Kafka", "Kinesis"), ("Airflow", "Luigi"), ("Kafka", "Spark"), ("Java", "Python")]
SKILLS = ["MySQL", "Python", "SQL", "Spark"]
YEARS = 4.0
RESUME = "Data engineer for platform teams\nPython and SQL pipelines with Spark; steel parts for automobile customers"
TAX = S.Taxonomy.of(TAXONOMY)
PROFILE = M.Profile(tuple(SKILLS), YEARS, RESUME, None, (("Data engineering", "Spark"), ("ETL", "Spark")), (("Java", "Python"), ("Kafka", "Spark")), G.Eligibility(countries=("US",), needs_sponsorship=True, languages=("German",)))


def aliases(spark):
    return rows(spark, [(s, c, a, x) for s, c, a, x in TAXONOMY], "skill string, category string, alias string, context array<string>")


def all_scores(spark, sf_dir):
    """The scores of all derived postings, worked out once for each state of the tables."""
    inputs, made = [f"{sf_dir}/{t}.parquet" for t in TABLES], []

    def make(k):
        made.extend([] if made else M.scored_texts(postings(spark, sf_dir), TAX, PROFILE))
        return made[k]

    name = f"of {POSTINGS} by {TAX!r} for {PROFILE!r}"
    texts = kept(spark, f"scores {name}", inputs, lambda: make(1))
    return M.with_scores(kept(spark, f"postings {name}", inputs, lambda: make(0)), texts)


# --- SQL of mentions: every run of up to four words against the aliases, clause by clause ----------------------------------

_ALIASES = ", ".join(f"('{s}', '{a.replace('node.js', 'node.js').replace('/', ' ')}', {'[' + ', '.join(repr(w) for w in x) + ']' if x else '[]::varchar[]'})" for s, _, a, x in TAXONOMY)
_MARKS = "('.', ';', ':', '!', '?', chr(10), '•')"
_BREAKS = "('.', ';', ':', '!', '?', chr(10), '•', 'but', 'however', 'whereas')"
_UPTO = "case when list_position(list_transform({0}, lambda x: x in " + _BREAKS + "), true) > 0 then ({0})[1:list_position(list_transform({0}, lambda x: x in " + _BREAKS + "), true) - 1] else {0} end"
_BEFORE = _UPTO.format("list_reverse(w[greatest(1, pos - 6):pos - 1])")
_AFTER = _UPTO.format("w[pos + n:pos + n + 7]")
_NEAR = f"""list_concat(list_filter(list_reverse(w[greatest(1, pos - 16):pos - 1]), lambda x: x not in {_MARKS})[1:8], list_filter(w[pos + n:pos + n + 15], lambda x: x not in {_MARKS})[1:8])"""
_WORDS = r"regexp_extract_all(lower(regexp_replace({0}, '(?i)\b(spring|summer|fall|autumn|winter)\s+(term\s+|semester\s+|of\s+)?''?\d{{2,4}}\b', ' ', 'g')), '\.?[a-z0-9+#_]+(?:\.[a-z0-9+#_]+)*(?:''t)?|[.;:!?\n•]')"


def sql_hits(source: str, text: str, name: str) -> str:
    return f"""{name}_w as (select id, {_WORDS.format(text)} as w from {source}), {name}_pos as (select id, w, unnest(range(1, len(w) + 1)) as pos from {name}_w),
    {name}_runs as (select id, w, pos, unnest([1, 2, 3, 4]) as n from {name}_pos),
    {name} as (select id, skill, len(list_filter(w[1:pos], lambda x: x = chr(10))) as line,
        len(list_filter({_BEFORE}, lambda x: x in ('no', 'not', 'without', 'never', 'non', 'nor') or ends_with(x, 'n''t'))) > 0
            or regexp_matches(array_to_string({_AFTER}, ' '), '^(\\S+ ){{0,4}}?((is|are) )?(not|\\S*n''t) (required|needed|necessary|mandatory|a requirement)( |$)') as neg
        from {name}_runs join (values {_ALIASES}) a(skill, alias, context) on alias = array_to_string(w[pos:pos + n - 1], ' ')
        where pos + n - 1 <= len(w) and (len(context) = 0 or list_has_any({_NEAR}, context)))"""


SQL_MENTIONS = f"{P}, {sql_hits('p', 'description', 'hits')}, mentions as (select id, skill, bool_and(neg) as negated from hits group by id, skill)"


@query(f"with {SQL_MENTIONS} select id, skill, negated from mentions")
def skill_mentions(spark, sf_dir):
    return S.mentions(postings(spark, sf_dir), TAX)


@query(f"with {SQL_MENTIONS} select id, skill, negated from mentions")
def skill_mentions_joined(spark, sf_dir):
    """The form for taxonomies of any size."""
    return S.mentions_joined(postings(spark, sf_dir), aliases(spark), longest=4)


@query(f"""with {SQL_MENTIONS} select skill, count(*) as postings, round(100.0 * count(*) / (select count(*) from p), 6) as pct from mentions where not negated group by skill order by postings desc, skill limit 5""")
def top_skills(spark, sf_dir):
    p = postings(spark, sf_dir)
    n = p.agg(F.count("*").alias("n"))
    found = S.mentions(p, TAX).where("not negated").groupBy("skill").agg(F.count("*").alias("postings")).crossJoin(F.broadcast(n))
    return found.select("skill", "postings", F.round(F.col("postings") * 100.0 / F.col("n"), 6).alias("pct")).orderBy(F.desc("postings"), "skill").limit(5)


_CLOSURE = f"c(src, dst) as (select * from (values {values(IMPLIES)}) e(src, dst) union select c.src, e.dst from c join (values {values(IMPLIES)}) e(src, dst) on c.dst = e.src)"


_EDGES = "select concat('s', cast(p_partkey as varchar(20))) as src, concat('s', cast(cast(floor(p_partkey / 3) as bigint) as varchar(20))) as dst from part where p_partkey > 2"


@query(f"with recursive e as ({_EDGES}), c(src, dst) as (select * from e union select c.src, e.dst from c join e on c.dst = e.src) select src, dst from c")
def ontology_closure(spark, sf_dir):
    """Each part implies the one of a third of its number: what follows from what, at any length."""
    return M.closure(spark.sql(_EDGES.replace("from part", "from {part}"), part=table(spark, sf_dir, "part")))


@query(f"""with recursive {_CLOSURE}, owned(skill) as (values {values([(s,) for s in SKILLS])}), {SQL_MENTIONS},
    pairs(a, b) as (select * from (values {values(RELATED)}) r(a, b) union select b, a from (values {values(RELATED)}) r(a, b)),
    i as (select dst as skill, min(src) as v from c join owned on src = owned.skill group by dst), r as (select a as skill, min(b) as v from pairs join owned on b = owned.skill group by a)
    select id, m.skill, case when o.skill is not null then 'exact' when i.v is not null then 'implied' when r.v is not null then 'related' else 'missing' end as how,
        case how when 'exact' then 1.0::double when 'implied' then 1.0 when 'related' then 0.5 else 0.0 end as credit, case how when 'implied' then i.v when 'related' then r.v end as via
    from mentions m left join owned o on o.skill = m.skill left join i on i.skill = m.skill left join r on r.skill = m.skill""")
def skill_credit(spark, sf_dir):
    owned = rows(spark, [(s,) for s in SKILLS], "skill string")
    related = rows(spark, RELATED, "a string, b string")
    asked = S.mentions(postings(spark, sf_dir), TAX).select("id", "skill")
    return M.credits(asked, owned, M.closure(rows(spark, IMPLIES, "src string, dst string")), related.union(related.select("b", "a")).distinct(), 0.5).select("id", "skill", "how", "credit", "via")


_NAMED = "[A-Za-z][A-Za-z./]*[A-Za-z]"


@query(f"""with {P}, n as (select distinct ' ' || unnest(regexp_extract_all(description || ' apache spark', '{_NAMED}')) || ' ' as name from p), t(skill, category, alias) as (values {", ".join(f"('{s}', '{c}', '{a}')" for s, c, a, _ in TAXONOMY)}),
    k as (select lower(skill) as k, skill, 0 as rank from t union all select alias, skill, 1 from t)
    select name, any_value(k.skill) as skill, coalesce(any_value(category), 'Other') as category from n left join (select k, arg_min(skill, (rank, skill)) as skill from k group by k) k on k.k = lower(trim(name)) left join (select skill, min(category) as category from t group by skill) c on c.skill = k.skill group by name""")
def canonical_skills(spark, sf_dir):
    """Every word of the derived postings as a skill's name, in its case and with blanks around it."""
    words = F.regexp_extract_all(F.concat("description", F.lit(" apache spark")), F.lit(_NAMED), F.lit(0))
    names = postings(spark, sf_dir).select(F.explode(words).alias("w")).distinct().select(F.concat(F.lit(" "), "w", F.lit(" ")).alias("name"))
    return S.categorised(S.canonical(names, aliases(spark)), aliases(spark)).select("name", "skill", "category")


@query("select distinct a.p_name as a, b.p_name as b from part a join part b on a.p_brand = b.p_brand and a.p_name <> b.p_name")
def related_skills(spark, sf_dir):
    """Names that share a brand."""
    return M.related_pairs(table(spark, sf_dir, "part").select(F.col("p_brand").alias("group"), F.col("p_name").alias("skill")))


# --- requirement lines ---------------------------------------------------------------------------------------------------

_CUE = r"'(?i)\b(experience|proficien|knowledge|familiar|degree|must|required|ability to|skills?|years?|understanding|expertise|background in|certif|fluent|hands-on)\b'"
_STOP = (
    "a an and are as at be by for from has have in is it its of on or our that the their this to we will with you your about all also any can more must other per such team work working years year experience strong "
    "ability skills including etc new over us who what when which role job responsibilities requirements qualifications company looking join help build using use well within across candidate position opportunity "
    "benefits able excellent good great solid proven knowledge understanding familiarity familiar proficiency proficient plus bonus nice preferred required requirement must should would like ideal ideally least "
    "minimum demonstrated relevant related similar equivalent field environment environments based high level highly hands ensure within into through both each other them they these those where while you'll we're you're it's"
).replace("'", "''").split()
_STOPS = "(" + ", ".join(f"'{w}'" for w in _STOP) + ")"
SQL_TERMS = """list_transform(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z][a-z+#.\\-]{{2,}}'), lambda w: w not in {1} and length(w) > 3),
    lambda w: case when length(trim(w, '.-')) <= 5 then trim(w, '.-') when ends_with(trim(w, '.-'), 'ing') then regexp_replace(trim(w, '.-'), 'ing$', '') when ends_with(trim(w, '.-'), 'ies') then regexp_replace(trim(w, '.-'), 'ies$', 'y')
        when ends_with(trim(w, '.-'), 'es') then regexp_replace(trim(w, '.-'), 'es$', '') when ends_with(trim(w, '.-'), 's') then regexp_replace(trim(w, '.-'), 's$', '') when ends_with(trim(w, '.-'), 'ed') then regexp_replace(trim(w, '.-'), 'ed$', '') else trim(w, '.-') end)"""

#: Sections by windows: a heading opens one, prose behind bullets ends it. Lines of the derived postings are under 160 characters.
SQL_LINES = f"""{SQL_MENTIONS}, raw as (select id, unnest(string_split(description, chr(10))) as line, unnest(range(len(string_split(description, chr(10))))) as no from p),
    told as (select id, no, trim(line) as raw, regexp_matches(trim(line), '^\\s*(?:[•\\-*·▪►◦–]|\\d{{1,2}}[.)])\\s*') as bullet, trim(regexp_replace(trim(line), '^\\s*(?:[•\\-*·▪►◦–]|\\d{{1,2}}[.)])\\s*', '')) as text from raw where trim(line) <> ''),
    skilled as (select t.*, h.id is not null as skill, regexp_matches(text, {_CUE}) as cue,
        case when not bullet and length(text) <= 70 and (ends_with(text, ':') or len(regexp_split_to_array(text, '\\s+')) <= 7) then
            case when regexp_matches(text, '(?i)nice[\\s-]*to[\\s-]*have|preferred|bonus|good to have|desirable|a plus|pluses|extra credit|ideal') then 'pref'
                when regexp_matches(text, '(?i)benefit|perk|what we offer|we offer|about us|about the company|who we are|why (join|us|work)|compensation|salary|the role|about the role|responsibilit|you will') then 'skip'
                when regexp_matches(text, '(?i)requirement|qualification|who you are|about you|you have|must[\\s-]have|skills|experience|your profile|you should|you bring|ideal candidate') then 'req' end end as head
        from told t left join (select distinct id, line from hits) h on h.id = t.id and h.line = t.no),
    grouped as (select *, count(head) over w as g, last_value(head ignore nulls) over w as section from skilled window w as (partition by id order by no rows unbounded preceding)),
    fit as (select *, coalesce(section in ('req', 'pref'), false) and head is null and length(text) between 2 and 320 and (length(text) >= 15 or skill or len({SQL_TERMS.format('text', _STOPS)}) > 0) as fits from grouped),
    prose as (select *, coalesce(section in ('req', 'pref'), false) and head is null and not bullet and (length(text) > 100 or contains(text, '. ')) and not cue and not skill
        and coalesce(sum(case when fits and bullet then 1 else 0 end) over (partition by id, g order by no rows between unbounded preceding and 1 preceding), 0) > 0 as prose from fit),
    closed as (select *, coalesce(bool_or(prose) over (partition by id, g order by no rows unbounded preceding), false) as closed, coalesce(bool_or(prose) over (partition by id, g order by no rows between unbounded preceding and 1 preceding), false) as was_closed from prose),
    lines as (select id, no, case when fits and not closed then text else regexp_replace(text, '[.]+$', '') end as text, fits and not closed as kept, case when fits and not closed then section = 'pref' else regexp_matches(text, '(?i)nice[\\s-]*to[\\s-]*have|preferred|bonus|good to have|desirable|a plus|pluses|extra credit|ideal') end as preferred
        from closed where (fits and not closed) or (head is null and (section is null or was_closed) and length(text) between 15 and 320 and cue)),
    ruled as (select id, bool_or(head = 'req') as found from skilled group by id),
    owned_lines as (select l.*, coalesce(found, false) or coalesce(bool_or(kept and preferred) over (partition by l.id), false) as own from lines l join ruled using (id)),
    req_lines as (select id, no, text, preferred from owned_lines where kept or not own qualify row_number() over (partition by id order by kept, no) <= 25)"""


@query(f"with {SQL_LINES} select id, cast(no as int) as line_no, text, preferred from req_lines")
def requirement_lines(spark, sf_dir):
    def lines(texts):
        hits = texts.withColumn("hits", S.hits_in(S.words_of(F.col("description")), TAX))
        return hits.select("_text", F.inline(Q.requirement_lines(F.col("description"), F.transform("hits", lambda h: h["line"]))))

    found = of_each_text(postings(spark, sf_dir).select("id", "description"), ["description"], lines)
    return found.select("id", F.col("line").alias("line_no"), "text", "preferred")


SQL_YEARS = r"""years as (select id, list_min(list_filter(list_transform(regexp_extract_all(description, '(?i)(\d{1,2})\s*\+?\s*(?:years?|yrs?)\b[^.\n]{0,40}?experience', 1), lambda x: cast(x as double)), lambda n: n between 1 and 20)) as stated,
    case when regexp_matches(title, '(?i)\b(principal|staff|head of|director)\b') then 8 when regexp_matches(title, '(?i)\b(lead|manager)\b') then 6 when regexp_matches(title, '(?i)\b(senior|sr)\b') then 5
        when regexp_matches(title, '(?i)\b(junior|jr|entry|graduate|intern|trainee|associate)\b') then 0 end as senior from p)"""


@query(f"with {P}, {SQL_YEARS} select id, cast(coalesce(stated, senior) as double) as years, stated is null as inferred from years")
def required_years(spark, sf_dir):
    return postings(spark, sf_dir).select("id", Q.required_years(F.col("title"), F.col("description")).alias("y")).select("id", "y.years", "y.inferred")


_RESUME = RESUME.replace("'", "''")
SQL_ROLE = f"""fits as (select id, title, list_filter(regexp_extract_all(lower(title), '[a-z+#.]+'), lambda t: t not in ('senior', 'sr', 'junior', 'jr', 'lead', 'principal', 'staff', 'associate', 'intern', 'ii', 'iii', 'i', 'the', 'and', 'of', 'for', 'a', 'an', 'in', 'at',
        'remote', 'hybrid', 'contract', 'full', 'time', 'part')) as ordered from p),
    word as (select id, unnest(list_distinct(ordered)) as t from fits), weighed as (select id, t, case when t in ('engineer', 'developer', 'specialist', 'analyst', 'manager') then 0.4 else 1.0 end as wt, regexp_matches(lower('{_RESUME}'), '\\b' || replace(t, '.', '\\.')) as hit from word),
    role as (select id, least(1.0, 0.7 * sum(wt * hit::int) / sum(wt) + case when bool_or(contains(lower('{_RESUME}'), array_to_string(ordered, ' '))) then 0.3 else 0 end + case when bool_or(wt = 1.0 and hit) then 0.1 else 0 end) as role
        from weighed join fits f using (id) group by id)"""


@query(f"with {P}, {SQL_ROLE} select id, round(role, 9) as fit from role")
def title_fit(spark, sf_dir):
    return postings(spark, sf_dir).select("id", F.round(M.title_fit(F.col("title"), PROFILE.text, PROFILE.head), 9).alias("fit"))


# --- scores --------------------------------------------------------------------------------------------------------------

_OWNED = "('MySQL', 'Python', 'SQL', 'Spark')"
_CREDIT = f"case when skill in {_OWNED} then 1.0 when skill in ('Java', 'Kafka') then 0.5 else 0.0 end"


def sql_grams(source: str, text: str) -> str:
    return f"""(select id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) as term from (select id, {SQL_TERMS.format(text, _STOPS)} as w from {source}))"""


SQL_SIMILAR = f"""mine as (select id, term, count(*) as tf from {sql_grams('p', 'description')} group by id, term),
    theirs as (select term, count(*) as tf from {sql_grams(f"(select 0 as id, '{_RESUME}' as t)", 't')} group by term),
    idf as (select term, ln((2 + (select count(*) from p)) / (1 + count(*))) + 1 as idf from (select term from mine union all select term from theirs) group by term),
    asked as (select term, (1 + ln(tf)) * idf as wq from theirs join idf using (term)),
    cosines as (select id, sum((1 + ln(m.tf)) * idf * coalesce(wq, 0)) / (sqrt(sum(((1 + ln(m.tf)) * idf) ** 2)) * (select sqrt(sum(wq * wq)) from asked)) as cosine
        from mine m join idf using (term) left join asked using (term) group by id)"""


@query(f"with {P}, {SQL_SIMILAR} select id, round(coalesce(cosine, 0), 9) as cosine from p left join cosines using (id)")
def semantic_similarity(spark, sf_dir):
    return M.similarity(postings(spark, sf_dir), "id", "description", RESUME).select("id", F.round("cosine", 9).alias("cosine"))


SQL_SCORES = f"""{SQL_LINES}, {SQL_SIMILAR}, {SQL_YEARS}, {SQL_ROLE}, {sql_hits('p', 'title', 'title_hits')},
    heading as (select id, min(no) as pref_line from raw where regexp_matches(line, '(?i)^\\W*(nice[\\s-]*to[\\s-]*haves?|preferred|bonus|good to have|desirable|a plus|pluses|extra credit|ideal(ly)?)\\b') group by id),
    placed as (select h.id, skill, neg, coalesce(h.line >= pref_line, false) as pref from hits h left join heading using (id) union all select id, skill, neg, false from title_hits),
    required as (select id, skill from placed where not pref and not neg group by all),
    preferred as (select distinct id, skill from placed where pref and not neg and (id, skill) not in (select (id, skill) from required)),
    negs as (select distinct id, skill from placed where neg and (id, skill) not in (select (id, skill) from required) and (id, skill) not in (select (id, skill) from preferred)),
    weights as (select id, skill, case when skill in ('Communication', 'Collaboration') then 0.5 else 1.0 end as wt, {_CREDIT} as credit from required
        union all select id, skill, 0.5 * case when skill in ('Communication', 'Collaboration') then 0.5 else 1.0 end, {_CREDIT} from preferred),
    skill_parts as (select id, sum(wt * credit) / sum(wt) as skills, array_to_string(list(skill order by skill) filter (credit >= 1), ',') as matched, array_to_string(list(skill order by skill) filter (credit < 1), ',') as missing from weights group by id),
    line_skills as (select id, line as no, skill, bool_and(neg) as neg from hits group by id, line, skill),
    per_line as (select id, no, count(*) as named, count(*) filter (not neg) as asked, avg({_CREDIT}) filter (not neg) as mean, max({_CREDIT}) filter (not neg) as best from line_skills group by id, no),
    profile_terms as (select list({SQL_TERMS.format("'" + _RESUME + "'", _STOPS)}) as t), own_terms as (select {SQL_TERMS.format("'" + _RESUME + "'", _STOPS)} as own),
    judged as (select l.id, l.no, l.text, preferred, regexp_matches(l.text, '(?i)\\bor\\b|/|\\beither\\b|\\bsimilar\\b|\\bequivalent\\b') as alt, named, asked, mean, best,
        nullif(regexp_extract(l.text, '(?i)(\\d{{1,2}})\\s*\\+?\\s*(?:years?|yrs?)\\b', 1), '') as need, regexp_matches(l.text, '(?i)\\bdegree\\b') as degree, list_distinct({SQL_TERMS.format('l.text', _STOPS)}) as terms, own
        from req_lines l left join per_line s on s.id = l.id and s.no = l.no, own_terms),
    covered as (select *, case when asked > 0 then case when alt and best >= 1 then 1.0 when alt then greatest(mean, best) else mean end when named > 0 then null
        when need is not null and regexp_matches(text, '(?i)experience|exp\\b') then least(1.0, {YEARS} / cast(need as double)) when degree then 0.0
        when len(terms) >= 2 then len(list_intersect(terms, own)) / len(terms) end as coverage from judged),
    coverage as (select id, sum(case when preferred then 0.5 else 1.0 end * coverage) / sum(case when preferred then 0.5 else 1.0 end) as requirements, count(*) as n_lines, count(*) filter (coverage >= 0.75) as met from covered where coverage is not null group by id),
    degrees as (select id, arg_min(not preferred and not regexp_matches(text, '(?i)preferred|or equivalent'), no) as strict from req_lines where regexp_matches(text, '(?i)\\bdegree\\b') group by id),
    parts as (select p.id, source, company, location, description, coalesce(matched, '') as matched, coalesce(missing, '') as missing, coalesce((select array_to_string(list(skill order by skill), ',') from negs n where n.id = p.id), '') as negated,
        coalesce(skills, 0) as skills, coalesce(requirements, skills, 0) as requirements, coalesce(n_lines, 0) as n_lines, coalesce(met, 0) as met, role,
        coalesce(stated, senior) as years, stated is null as inferred, case when coalesce(stated, senior) is null then 0.85::double when coalesce(stated, senior) = 0 then 1.0 else least(1.0, {YEARS} / coalesce(stated, senior)) end as experience,
        least(1.0, coalesce(cosine, 0) / 0.30) as semantic, case when strict then 0.08 when strict is not null then 0.02 else 0 end as penalty, length(description) < 80 as short
        from p left join skill_parts using (id) left join coverage using (id) left join role using (id) left join years using (id) left join cosines using (id) left join degrees using (id)),
    scores as (select *, cast(round_even(round(greatest(0.0, least(1.0, case when short then least(t, 0.45) else t end)) * 100, 9), 0) as int) as score
        from (select *, 0.40::double * skills + 0.20::double * requirements + 0.15::double * role + 0.15::double * experience + 0.10::double * semantic - penalty as t from parts))"""


@query(f"""with {SQL_SCORES} select id, matched, missing, negated, round(skills, 6) as skills, round(requirements, 6) as requirements, n_lines, met, round(role, 6) as role, round(experience, 6) as experience, penalty::double as penalty, score from scores""")
def posting_scores(spark, sf_dir):
    told = all_scores(spark, sf_dir).withColumns({"n_lines": F.size("requirement_rows").cast("long"), "met": F.col("requirements_met").cast("long")})
    joined = [F.array_join(c, ",").alias(c) for c in ("matched", "missing", "negated")]
    return told.select("id", *joined, *(F.round(c, 6).alias(c) for c in ("skills", "requirements", "role", "experience")), "n_lines", "met", "penalty", "score")


@query(f"""with {SQL_SCORES} select id, no_ as line_id, coverage, status from (select id, text, round(coverage, 6) as coverage, case when coverage >= 0.75 then 'met' when coverage >= 0.35 then 'partial' else 'missing' end as status,
    'r' || row_number() over (partition by id order by no) as no_ from covered where coverage is not null)""")
def requirement_coverage(spark, sf_dir):
    found = all_scores(spark, sf_dir).select("id", F.inline("requirement_rows").alias("line_id", "text", "preferred", "coverage", "missing", "how", "status"))
    return found.select("id", "line_id", F.round("coverage", 6).alias("coverage"), "status")


@query(f"""with {SQL_SCORES} select count(*) as job_count, cast(round_even(avg(score), 0) as int) as avg_score, count(*) filter (score >= 60 and penalty <> 0.08) as qualifying, count(*) filter (score >= 60) as score_qualifying,
    count(*) filter (score >= 60 and penalty = 0.08) as gate_failed, count(*) filter (score < 20) as bucket_0, count(*) filter (score >= 20 and score < 40) as bucket_1,
    count(*) filter (score >= 40 and score < 60) as bucket_2, count(*) filter (score >= 60 and score < 80) as bucket_3, count(*) filter (score >= 80) as bucket_4 from scores""")
def report_summary(spark, sf_dir):
    """Of the derived postings only the strict degree is a gate that fails."""
    return M.report(all_scores(spark, sf_dir), 60)


@query(f"""with {SQL_SCORES} select 'degree' as label, count(*) as failed, cast(0 as bigint) as unknown from scores where penalty = 0.08 and score >= 40 having count(*) > 0""")
def gate_breakdown(spark, sf_dir):
    return M.gate_breakdown(all_scores(spark, sf_dir), 40)


@query(f"""with {SQL_SCORES}, d as (select skill, count(*) as n, count(*) filter (credit < 1) as gap from weights group by skill), t as (select count(*) as n from p)
    select * from (select 'gap' as kind, skill, gap as jobs, cast(round_even(100 * gap / (select n from t), 0) as int) as pct from d where gap > 0 order by gap desc, skill limit 15)
    union all select * from (select 'strength', skill, n - gap, cast(round_even(100 * (n - gap) / (select n from t), 0) as int) from d where skill in {_OWNED} and n > gap order by n - gap desc, skill limit 12)""")
def skill_demand(spark, sf_dir):
    return M.skill_demand(all_scores(spark, sf_dir), PROFILE)


@query(f"with {SQL_SCORES} select * from (values ('MySQL'), ('Python'), ('SQL'), ('Spark')) o(skill) where skill not in (select skill from weights)")
def unused_skills(spark, sf_dir):
    return M.unused_skills(all_scores(spark, sf_dir), PROFILE)


@query(f"""with {SQL_SCORES} select * from (select 'Requires a Bachelor''s degree' as text, count(*) as jobs from scores where penalty = 0.08
    union all select 'More years of experience than the resume shows', count(*) from scores where not inferred and {YEARS} < 0.6 * years) where jobs > 0 order by jobs desc, text limit 5""")
def common_blockers(spark, sf_dir):
    return M.common_blockers(all_scores(spark, sf_dir))


@query(f"""with {SQL_SCORES} select id, case when score >= 60 and penalty <> 0.08 then 'qualified' when score >= 60 then 'gate' when score >= 45 then 'near' else 'below' end as status from scores""")
def posting_standing(spark, sf_dir):
    return M.failed_gates(all_scores(spark, sf_dir)).select("id", M.standing(60).alias("status"))


@query(f"""with {SQL_SCORES}, h as (select least(9, score // 10) as bin, count(*) as n from scores group by 1) select cast(b as int) as bin, coalesce(n, 0) as n from (select unnest(range(10)) as b) left join h on bin = b""")
def score_histogram(spark, sf_dir):
    counted = all_scores(spark, sf_dir).groupBy(F.least(F.lit(9), F.floor(F.col("score") / 10).cast("int")).alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(10).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").fillna(0)


_STATUS = "case when score >= 60 and penalty <> 0.08 then 'qualified' when score >= 60 then 'gate' else 'below' end"
_PLACE = "case when coalesce(remote, case when contains(lower(p.location), 'remote') then true end) then 'remote' when coalesce(remote, case when contains(lower(p.location), 'remote') then true end) is null then 'unknown' else 'onsite' end"


@query(f"""with {SQL_SCORES}, f as (select s.source, company, {_STATUS} as status, {_PLACE} as workplace, score from scores s join (select id, remote, location from p) p using (id))
    select source, company, status, workplace, count(*) as n, count(*) filter (score >= 60) as q from f group by grouping sets ((source), (company), (status), (workplace))""")
def facet_counts(spark, sf_dir):
    """Counts by source, company, status and workplace at once."""
    from ..functions.text import is_remote

    away = is_remote(F.col("remote"), F.col("location"))
    where = postings(spark, sf_dir).select("id", F.when(away, "remote").when(away.isNull(), "unknown").otherwise("onsite").alias("workplace"))
    told = M.failed_gates(all_scores(spark, sf_dir)).join(where, "id").withColumn("status", F.when(M.standing(60) == "near", "below").otherwise(M.standing(60)))
    return told.groupingSets([["source"], ["company"], ["status"], ["workplace"]], "source", "company", "status", "workplace").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 60).alias("q"))


@query(f"with {SQL_SCORES} select source, floor(median(score) + 0.5) as median_score from scores group by source")
def median_scores(spark, sf_dir):
    return all_scores(spark, sf_dir).groupBy("source").agg(F.floor(F.median("score") + 0.5).cast("double").alias("median_score"))


@query(f"""with {SQL_SCORES} select count(*) as jobs, count(*) filter (b > score) as raised, count(*) filter (b < score) as lowered, count(*) filter (score < 60 and b >= 60) as unlocked, avg(b - score) as mean_change
    from (select score, cast(round_even(round(greatest(0.0, least(1.0, case when short then least(u, 0.45) else u end)) * 100, 9), 0) as int) as b from (select *, t + 0.15::double * (case when years is null then 0.85 else 1 end - experience) as u from scores))""")
def what_if_years(spark, sf_dir):
    """The same postings for a person of more years than any asks for; requirement lines of years are left as they are."""
    before = all_scores(spark, sf_dir)
    parts = {k: F.col(k) for k in ("skills", "requirements", "role", "semantic")} | {"experience": M.experience_score(F.col("required_years"), 40.0)}
    return M.rescored(before, before.withColumn("score", M.total_score(parts, F.col("penalty"), F.col("capped"))), 60)
