"""The posting funnel: relevance, filters with a drop reason, merging of duplicates, ranking, and a fair pick over sources.

Rows are tagged, not lost: `tagged` gives every posting its drop reason, and counters are aggregates over the tags.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable, spread
from ..functions.text import age_hours, alnum, city_key, core_tokens, is_remote, norm_company, norm_tokens, relevance
from ..functions.values import ANYWHERE, CITIES, COUNTRIES, EMPLOYMENT, JUNIOR_TITLE, OTHER_PRIORITY, REGIONS, SENIOR_TITLE, SOURCE_PRIORITY
from .near import BAND_BITS, BANDS, BUCKET, greedy_classes, matched, near_classes, simhash, simhash_of  # noqa: F401 (callers find them here)

GRACE = 6  #: hours by which a posting may be older than asked
LEAST_TEXT = 200  #: characters of a description that is held against others


@dataclass(frozen=True)
class Query:
    """What is sought. hours 0: any age; empty lists: anything."""

    title: str
    now: str
    location: str = ""
    count: int = 50
    hours: float = 0
    workplace: tuple[str, ...] = ()
    job_types: tuple[str, ...] = ()
    experience: tuple[str, ...] = ()
    alternatives: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    strict: bool = False
    lenient_sources: tuple[str, ...] = field(default=("linkedin",))
    unfiltered_sources: tuple[str, ...] = field(default=("url", "manual"))


def any_word(text: Column, words) -> Column:
    """Whether the lower-cased text has one of the words as a whole word."""
    words = sorted(set(words))
    return text.rlike(rf"(?<![a-z])({'|'.join(_quoted(w) for w in words)})(?![a-z])") if words else F.lit(False)


def _quoted(word: str) -> str:
    return "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in word)


def location_words(wanted: str) -> tuple[list[str], list[str], list[str], list[str]]:
    """Of a wanted place: its parts; words that fit any posting; words that fit remote ones; regions that hold it."""
    parts = [p.strip() for p in wanted.replace("/", ",").replace("|", ",").split(",") if len(p.strip()) >= 2]
    own = [c for c, names in COUNTRIES.items() if any(p == c or p in names for p in parts)]
    around = [c for c in COUNTRIES if c in own or any(p in CITIES.get(c, []) for p in parts)]
    fits = [w for c in own for w in (*COUNTRIES[c], *CITIES.get(c, []))]
    remote = [w for c in around for w in COUNTRIES[c]]
    padded = {r: f" {members} " for r, members in REGIONS.items()}
    regions = [r for r, members in padded.items() if any(f" {p} " in members for p in parts)]
    return parts, fits, remote, regions


def location_ok(location: Column, remote: Column, wanted: str) -> Column:
    """Whether a posting's place fits; blank wishes fit all, and remote postings fit where they aren't bound elsewhere."""
    wanted = wanted.strip().lower()
    if not wanted:
        return F.lit(True)
    away = F.coalesce(is_remote(remote, location), F.lit(False))
    if wanted in ANYWHERE:
        return away if wanted == "remote" else F.lit(True)
    low = F.lower(F.coalesce(location, F.lit("")))
    parts, fits, of_country, regions = location_words(wanted)
    free = (low == "") | any_word(low, ["worldwide", "anywhere", "global"]) | F.trim(low).isin("remote", "remote (worldwide)")
    return any_word(low, parts) | any_word(low, fits) | (away & (free | any_word(low, of_country) | any_word(low, regions)))


def drop_reason(query: Query) -> Column:
    """The first filter that a posting fails, or null."""
    reason = F
    if query.hours:
        reason = reason.when(F.coalesce(age_hours(F.col("posted"), query.now) > query.hours + GRACE, F.lit(False)), "too_old")
    reason = reason.when(~location_ok(F.col("location"), F.col("remote"), query.location), "location")
    if query.workplace:
        away = is_remote(F.col("remote"), F.col("location"))
        wrong = (away & F.lit("remote" not in query.workplace)) | (~away & F.lit(set(query.workplace) == {"remote"}))
        reason = reason.when(F.coalesce(wrong, F.lit(False)), "workplace")
    if query.job_types:
        low = F.lower(F.coalesce("employment_type", F.lit("")))
        has = {code: low.rlike("|".join(keys)) for code, keys in EMPLOYMENT.items()}
        known = F.lit(False)
        wanted = F.lit(False)
        for code, test in has.items():
            known = known | test
            wanted = wanted | (test if code in query.job_types else F.lit(False))
        reason = reason.when(known & ~wanted, "job_type")
    if query.experience:
        title, asked = F.lower("title"), set(query.experience)
        if asked <= {"internship", "entry"}:
            reason = reason.when(title.rlike(SENIOR_TITLE), "experience")
        if asked <= {"mid_senior", "director", "executive"}:
            reason = reason.when(title.rlike(JUNIOR_TITLE), "experience")
    return reason.otherwise(F.lit(None).cast("string"))


def tagged(postings: DataFrame, query: Query) -> DataFrame:
    """`postings` with relevance (0 to 1) and drop (the reason, or null): no_title, title, then those of `drop_reason`."""
    context = F.concat_ws(" ", F.col("tags") if "tags" in postings.columns else F.lit(""), F.substring("description", 1, 800))
    best = F.greatest(F.lit(0.0), *(relevance(F.col("title"), context, F.lit(t)) for t in (query.title, *query.alternatives[:12])))
    tokens = norm_tokens(F.col("title"))
    for other in query.excluded:
        core = core_tokens(F.lit(other))
        best = F.when((F.size(core) > 0) & (F.size(F.array_except(core, tokens)) == 0), 0.0).otherwise(best)
    bar = 0.75 if query.strict else 0.5
    exempt = F.col("source").isin(*query.unfiltered_sources) | (F.col("source").isin(*query.lenient_sources) & F.lit(not query.strict))
    drop = F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "no_title").when((F.col("relevance") < bar) & ~exempt, "title").otherwise(drop_reason(query))
    return postings.withColumn("relevance", best).withColumn("drop", drop)


def tagged_once(postings: DataFrame, query: Query) -> DataFrame:
    """`tagged`, written: a filter on its tags would work them out again in each of its uses. Dropped rows leave their descriptions behind."""
    return durable(tagged(postings, query).withColumn("description", F.when(F.col("drop").isNull(), F.col("description"))))


def priority(source: Column) -> Column:
    told = F.create_map(*(F.lit(x) for pair in SOURCE_PRIORITY.items() for x in pair))
    return F.coalesce(F.try_element_at(told, source), F.lit(OTHER_PRIORITY))


def merge_key() -> Column:
    company = norm_company(F.col("company"))
    place = F.concat_ws("|", company, alnum(F.col("title")), city_key(F.col("location"), F.col("remote")))
    return F.when(company == "", F.concat(F.lit("url|"), F.coalesce("url", "id"))).otherwise(place)


def merged(postings: DataFrame, key: Column | None = None) -> DataFrame:
    """One posting for each company, title and city: that of the best source, with all sources, and the longest description if 200 longer.

    Groups are reduced by aggregates with map-side partial results, so a group of any size is no single task's burden.
    """
    rank = F.struct(priority(F.col("source")).alias("p"), -F.length("description"), F.col("id"))
    rows = postings.withColumn("_key", merge_key() if key is None else key)
    columns = [c for c in postings.columns if c not in ("sources", "copies")]
    own = F.array("source")
    given = F.when(F.size("sources") > 0, F.col("sources")).otherwise(own) if "sources" in postings.columns else own
    copies = F.sum("copies") if "copies" in postings.columns else F.count("*")
    best = F.min_by(F.struct(*columns), rank).alias("best")
    longest = F.min_by("description", F.struct(-F.length("description"), rank)).alias("longest")
    grouped = rows.groupBy("_key").agg(best, longest, F.array_distinct(F.flatten(F.collect_set(given))).alias("s"), copies.alias("copies"))
    text = F.when(F.length("longest") > F.length("best.description") + 200, F.col("longest")).otherwise(F.col("best.description"))
    out = [text.alias(c) if c == "description" else F.col(f"best.{c}") for c in columns]
    return grouped.select(*out, F.transform(F.array_sort(F.transform("s", lambda x: F.struct(priority(x).alias("p"), x.alias("source")))), lambda x: x["source"]).alias("sources"), "copies")


def near_hashes(distinct: DataFrame, block: list[str], most: int, bucket: int = BUCKET) -> DataFrame:
    """block, hash_a < hash_b, bits: distinct hashes of one block that differ in at most `most` bits.

    Hashes that differ in under BANDS bits share one of BANDS bands, so blocks are joined on a band's value, not crossed. For
    tables whose pairs are few and wanted as rows; `near_classes` and `greedy_classes` tell of every row without them.
    """
    if most >= BANDS:
        raise ValueError("more differing bits than bands")
    bands = F.array(*(F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("simhash", k * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).alias("value")) for k in range(BANDS)))
    place = F.struct(*block).alias("block")
    banded = distinct.select(place, "simhash", F.inline(bands))
    held = banded.groupBy("block", "band", "value").agg(F.ceil(F.count("*") / bucket).cast("int").alias("parts"), F.count("*").alias("size")).where("size > 1").drop("size")
    sides = banded.join(held, ["block", "band", "value"]).withColumn("side", F.pmod(F.xxhash64("simhash"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = sides.select("block", "band", "value", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "simhash")
    keys = ["block", "band", "value", "low", "high"]
    a, b = dealt.alias("a"), dealt.alias("b")
    met = F.col("a.simhash") < F.col("b.simhash")
    met &= (F.col("a.low") == F.col("a.high")) | (F.col("a.side") != F.col("b.side"))
    bits = F.bit_count(F.col("a.simhash").bitwiseXOR(F.col("b.simhash")))
    for k in keys:
        met &= F.col(f"a.{k}") == F.col(f"b.{k}")
    found = a.join(b, met & (bits <= most)).select("a.block.*", F.col("a.simhash").alias("hash_a"), F.col("b.simhash").alias("hash_b"), bits.alias("bits"))
    return found.distinct()


def near_pairs(hashes: DataFrame, block: list[str], most: int = 3) -> DataFrame:
    """Pairs a < b of distinct hashes of one block that differ in at most `most` bits, with the least id that has each.

    Equal hashes are one row before; `near_classes` tells of every row.
    """
    distinct = hashes.where("simhash <> 0").groupBy(*block, "simhash").agg(F.min("id").alias("id"))
    found = near_hashes(distinct, block, most)
    for s in "ab":
        found = matched(found, distinct.withColumnsRenamed({"simhash": f"hash_{s}", "id": f"id_{s}"}), [*block, f"hash_{s}"])
    return found.select(*block, "id_a", "id_b", "bits")


def greedy_groups(unique: DataFrame) -> DataFrame:
    """Rows of `merged` with `_class`: the merge key of the first row, in the order of ids, whose description theirs is near at one company and city.

    Groups are those of `greedy_classes`; short and null descriptions are held against none.
    """
    unique = durable(unique.withColumn("_row", merge_key()))
    told = unique.where(F.length("description") >= LEAST_TEXT)
    hashes = spread(told.select("id", "_row", "description", norm_company(F.col("company")).alias("at"), city_key(F.col("location"), F.col("remote")).alias("city")), "_row")
    hashes = hashes.select(F.col("_row").alias("id"), F.col("id").alias("turn"), "at", "city", simhash_of(F.col("description")).alias("simhash"))
    groups = greedy_classes(hashes, ["at", "city"], [F.col("turn")]).select(F.col("id").alias("_row"), "leader_id")
    return unique.join(groups, "_row", "left").withColumn("_class", F.coalesce("leader_id", "_row")).drop("leader_id", "_row")


def deduplicated(postings: DataFrame) -> DataFrame:
    """`merged`, and then one posting for each greedy group of near-equal descriptions at one company and city, as of reposts with another title."""
    return merged(greedy_groups(merged(postings)), F.col("_class")).drop("_class")


def rank_score(relevance_: Column, description: Column, posted: Column, now: str, hours: float = 0) -> Column:
    age = age_hours(posted, now)
    recency = F.when(age.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - age / (hours or 720)))
    return 0.55 * relevance_ + 0.30 * F.least(F.length(description) / 1500, F.lit(1.0)) + 0.15 * recency


def fair_pick(scored: DataFrame, count: int) -> DataFrame:
    """The first `count` rows when sources take turns, the best first: with their place from 1.

    No source gives more than `count`, so each is cut by a group limit before the one global order of few rows.
    """
    own = Window.partitionBy("source").orderBy(F.desc("score"), "id")
    turns = scored.withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= count)
    best = scored.groupBy("source").agg(F.max("score").alias("source_best"))
    few = turns.join(F.broadcast(best), "source").orderBy("turn", F.desc("source_best"), "source").limit(count)
    return few.withColumn("place", F.row_number().over(Window.orderBy("turn", F.desc("source_best"), "source"))).drop("source_best")


def funnel(postings: DataFrame, query: Query) -> DataFrame:
    """The picked postings, ranked."""
    kept = tagged_once(postings, query).where("drop is null")
    unique = deduplicated(kept)
    score = rank_score(F.col("relevance"), F.col("description"), F.col("posted"), query.now, query.hours)
    return fair_pick(unique.withColumn("score", score), query.count)


def funnel_counts(postings: DataFrame, query: Query) -> DataFrame:
    """One row: fetched, relevant, after_filters, unique_rows, selected."""
    rows = tagged_once(postings, query)
    counts = rows.agg(F.count("*").alias("fetched"), F.count_if(F.coalesce("drop", F.lit("")).isin("no_title", "title") == F.lit(False)).alias("relevant"), F.count_if(F.col("drop").isNull()).alias("after_filters"))
    unique = deduplicated(rows.where("drop is null")).agg(F.count("*").alias("unique_rows"))
    return counts.crossJoin(unique).withColumn("selected", F.least("unique_rows", F.lit(query.count).cast("long")))


def drops_by_source(postings: DataFrame, query: Query) -> DataFrame:
    """source, drop (`kept` if none), n."""
    return tagged(postings, query).groupBy("source", F.coalesce("drop", F.lit("kept")).alias("drop")).agg(F.count("*").alias("n"))


def all_drops(postings: DataFrame, query: Query) -> DataFrame:
    """source, drop, n: postings lost to each reason, those merged into another (duplicate) and those beyond the count (over_limit) too."""
    rows = tagged_once(postings, query)
    kept = rows.where("drop is null")
    unique = durable(deduplicated(kept))
    score = rank_score(F.col("relevance"), F.col("description"), F.col("posted"), query.now, query.hours)
    counted = lambda df, n: df.groupBy("source").agg(F.count("*").alias(n))
    steps = counted(kept, "kept").join(counted(unique, "unique"), "source", "left").join(counted(fair_pick(unique.withColumn("score", score), query.count), "picked"), "source", "left").fillna(0)
    more = [("duplicate", F.col("kept") - F.col("unique")), ("over_limit", F.col("unique") - F.col("picked"))]
    late = steps.select("source", F.inline(F.array(*(F.struct(F.lit(k).alias("drop"), n.alias("n")) for k, n in more)))).where("n > 0")
    return rows.where("drop is not null").groupBy("source", "drop").agg(F.count("*").alias("n")).unionByName(late)
