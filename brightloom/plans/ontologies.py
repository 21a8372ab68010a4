"""Registered queries on ontologies, embeddings of requirement lines and greedy choices, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..durable import spread
from ..functions.phrases import EMBED_ENDINGS
from ..functions.values import STOP_EMBED
from ..operators import embedding as E
from ..operators import matching as M
from ..operators import near as N
from ..operators import ontology as O
from ..operators import skills as S
from .queries import SQL_SIMHASH, query, table
from .postings import postings
from .scoring import PROFILE, RESUME, SQL_LINES, SQL_SCORES, TAX, _WORDS

_ITEM = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def concepts(spark, sf_dir):
    """Each benchmark item is a concept: its first three words are the known name, the next three and the four behind them other labels."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    run = lambda at, n: F.array_join(F.slice(words, at, n), " ")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("uri"), run(1, 3).alias("preferred"), F.concat(run(4, 3), F.lit("|"), run(7, 4)).alias("alternatives"))


def known(spark, sf_dir):
    own = concepts(spark, sf_dir).where("preferred <> ''")
    return own.select(F.concat(F.lit("skill "), "uri").alias("skill"), F.lit("Items").alias("category"), F.col("preferred").alias("alias"), F.lit(None).cast("array<string>").alias("context"))


SQL_ALIASES = f"""items as (select item_id, {_ITEM} as w from benchmark),
    labels as (select item_id, unnest([0, 1, 2]) as place, unnest([array_to_string(w[1:3], ' '), array_to_string(w[4:6], ' '), array_to_string(w[7:10], ' ')]) as label from items),
    names as (select label as name, min('skill ' || item_id) as skill from labels where place = 0 and label <> '' group by label),
    linked as (select item_id, arg_min(skill, place) as skill from labels join names on name = label group by item_id),
    fresh as (select distinct skill, label as alias from labels join linked using (item_id) where label not in (select name from names) and regexp_matches(label, '^[a-z0-9][a-z0-9 +#./&-]{{1,40}}$')),
    taxonomy as (select 'skill ' || item_id as skill, label as alias from labels where place = 0 and label <> '' union select skill, alias from fresh)"""


@query(f"with {SQL_ALIASES} select skill, alias from fresh")
def ontology_aliases(spark, sf_dir):
    return O.new_aliases(concepts(spark, sf_dir), known(spark, sf_dir))


@query(f"""with {SQL_ALIASES}, words as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents), runs as (select doc_id, array_to_string(w[k:k + n - 1], ' ') as run from (select doc_id, w, unnest(range(1, len(w) + 1)) as k from words), (values (1), (2), (3), (4)) s(n) where k + n - 1 <= len(w))
    select distinct doc_id, skill from runs join taxonomy on alias = run""")
def ontology_links(spark, sf_dir):
    """Documents and the concepts that their whole texts name, by known names and by labels taken over."""
    base = known(spark, sf_dir)
    taxonomy = S.Taxonomy.load(O.extended(base, O.new_aliases(concepts(spark, sf_dir), base)))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return S.mentions(docs, taxonomy, "text").select(F.col("id").alias("doc_id"), "skill")


@query(f"""with recursive s0 as ({SQL_SIMHASH}), d as (select source, doc_id as id, simhash, row_number() over (partition by source order by n_chars desc, doc_id) as n from s0 join documents using (doc_id) where simhash <> 0),
    steps(source, n, leaders, chosen) as (select source, 0::bigint, []::struct(id bigint, h bigint)[], null::bigint from d group by source
        union all select source, d.n, case when met is null then list_append(leaders, {{'id': d.id, 'h': d.simhash}}) else leaders end, coalesce(met, d.id)
            from (select s.*, d.n, d.id, d.simhash, list_filter(s.leaders, lambda x: bit_count(xor(x.h, d.simhash)) <= 3)[1].id as met from (select source, n as was, leaders from steps) s join d on d.source = s.source and d.n = s.was + 1) d)
    select documents.source, doc_id as id, coalesce(chosen, doc_id) as leader_id from documents left join (select d.source, d.id, chosen from d join steps using (source, n)) c on c.id = doc_id and c.source = documents.source""")
def greedy_duplicates(spark, sf_dir):
    """Each document's leader within its source, when documents come one by one, the longest first."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars", "text"), "id")
    hashes = docs.select("id", "source", "n_chars", N.simhash_of(F.col("text")).alias("simhash"))
    return N.greedy_classes(hashes, ["source"], [-F.col("n_chars")])


# --- embeddings: the hashing one of 256 places, whose hash SQL knows too -------------------------------------------------------

_STEM = f"w[1:length(w) - length(coalesce(list_filter({list(EMBED_ENDINGS)}, lambda e: ends_with(w, e) and length(w) > length(e) + 3)[1], ''))]"


def sql_vectors(source: str, key: str, text: str, name: str) -> str:
    """{name} (key, v): unit vectors of 256 places."""
    return f"""{name}_w as (select {key}, list_transform(list_filter(regexp_extract_all(lower({text}), '[a-z0-9+#]+'), lambda w: w not in ({", ".join(f"'{w}'" for w in sorted(STOP_EMBED))})), lambda w: {_STEM}) as w from {source}),
    {name}_f as (select {key}, unnest(list_concat(list_transform(w, lambda x: {{'f': 'w:' || x, 'v': 1.0::double}}), list_transform(range(1, len(w)), lambda k: {{'f': 'b:' || w[k] || '_' || w[k + 1], 'v': 0.7::double}}),
        flatten(list_transform(w, lambda x: list_transform(range(1, greatest(1, length(x) - 1) + 1), lambda k: {{'f': 'c:' || substr('#' || x || '#', k, 4), 'v': 0.25::double}}))))) as f from {name}_w),
    {name}_h as (select {key}, f.v as v, cast('0x' || substr(md5(f.f), 1, 16) as ubigint) as h from {name}_f),
    {name}_s as (select {key}, cast(h % 256 as int) as spot, sum(case when h >= 9223372036854775808 then v else -v end) as v from {name}_h group by all),
    {name}_m as (select {key}, map(list(spot), list(v)) as m, sqrt(sum(v * v)) as norm from {name}_s group by {key}),
    {name} as (select s.{key}, list_transform(range(256), lambda k: coalesce(m[cast(k as int)] / nullif(norm, 0), 0.0)) as v from {source} s left join {name}_m using ({key}))"""


_BEST = """sims as (select t.text, l.no, round(list_inner_product(t.v, l.v), 9) as sim from asked_v t, lines_v l),
    best as (select text, arg_min(no, (-sim, no)) as no, max(sim) as sim from sims group by text)"""
_PARTS = "select distinct 'Shipped ' || p_name || ' of ' || lower(p_type) || ' grade to customers' as line from part"


@query(f"""with {SQL_LINES}, asked_t as (select distinct text from req_lines), parts as (select line, row_number() over (order by line) as no from ({_PARTS})),
    {sql_vectors("asked_t", "text", "text", "asked_v")}, {sql_vectors("parts", "no", "line", "lines_v")}, {_BEST}
    select text, best.no as line_no, line, round(sim, 6) as sim from best join parts using (no)""")
def best_resume_lines(spark, sf_dir):
    """Each distinct requirement line of the postings, and the nearest of lines made of all parts."""
    from .scoring import requirement_lines

    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("Shipped "), "p_name", F.lit(" of "), F.lower("p_type"), F.lit(" grade to customers")).alias("line")).distinct()
    numbered = E.numbered_lines(parts, "line")
    found = E.best_lines(requirement_lines(spark, sf_dir).select("text"), numbered, E.embedder("md5"))
    return found.select("text", "line_no", "line", F.round("sim", 6).alias("sim"))


@query(f"""with {SQL_SCORES}, asked_t as (select distinct text from judged), own_lines as (select unnest(range(len(l))) as no, unnest(l) as line from (select list_filter(string_split('{RESUME}', chr(10)), lambda x: len(string_split(x, ' ')) >= 4) as l)),
    {sql_vectors("asked_t", "text", "text", "asked_v")}, {sql_vectors("own_lines", "no", "line", "lines_v")}, {_BEST},
    matched_t as (select c.*, greatest(0.0, least(1.0, (sim - 0.25) / 0.40)) as credit, line from covered c join (select text, no as best_no, sim from best) b on b.text = c.text join own_lines o on o.no = best_no),
    sem_t as (select *, coverage is not null and named is null and not (need is not null and regexp_matches(text, '(?i)experience|exp\\b')) and not degree and credit > coverage as semantic from matched_t where coverage is not null)
    select id, 'r' || row_number() over (partition by id order by no) as line_id, round(case when semantic then credit else coverage end, 6) as coverage, semantic, line as evidence from sem_t""")
def semantic_coverage(spark, sf_dir):
    """Coverage of requirement lines when lines without a skill are also held against the resume's lines by meaning."""
    scores = M.scored(postings(spark, sf_dir), TAX, PROFILE, E.embedder("md5"))
    rows = scores.select("id", F.inline("requirement_rows"))
    return rows.toDF("id", "line_id", *rows.columns[2:]).select("id", "line_id", F.round("coverage", 6).alias("coverage"), (F.col("how") == "semantic match").alias("semantic"), "evidence")
