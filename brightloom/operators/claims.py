"""Checks of rewritten text against its source: numbers, years, degrees and title words that the source doesn't have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let
from .skills import Taxonomy, hits_in, words_of

# --- fixed values: phrases and marks -----------------------------------------------------------------------------------
PLACEHOLDER = r"\[[^\]]{1,40}\]"
NUMBER = r"(?<![\w\[])(?:[$£€]\s?)?\d+(?:[.,]\d+)*\s*(?:%|x\b|k\b|m\b|bn\b|\+)?"
YEAR = r"\b(?:19[5-9]\d|20[0-4]\d)\b"
DEGREE = r"\b(?:ph\.?d|doctorate|master'?s|msc|m\.s\.|mba|bachelor'?s|bsc|b\.s\.|b\.a\.|degree)\b"
TITLE = r"\b(?:senior|lead|principal|staff|head of|director|manager|vp|chief|architect)\b"
INJECTION = (
    r"(?i)\b(?:ignore|disregard|forget)\b[^.\n]{0,40}\b(?:previous|prior|above|earlier|all)\b[^.\n]{0,40}\b(?:instructions?|prompts?|rules?|messages?)\b|"
    r"\byou are now\b|\bsystem prompt\b|\bnew instructions?\b\s*:|\bact as (?:an?|the)\b|<\s*/?\s*system\s*>"
)
PROPER = r"(?<![.!?]\s)(?<!^)\b([A-Z][a-zA-Z0-9&]+(?:\s+[A-Z][a-zA-Z0-9&]+)*)\b"
ACRONYM = r"^[A-Z]{2,}s?$"
COMMON_CAPITALS = (
    "I The A An Led Built Designed Developed Managed Created Delivered Improved Reduced Increased Owned Drove Launched Implemented Automated Migrated Mentored Partnered Collaborated Established Streamlined "
    "Optimized Optimised Shipped Scaled Spearheaded Architected Analyzed Analysed Worked Supported Prepared Ran Wrote Introduced Coordinated Trained Maintained Defined Used"
).split()


def all_of(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0)))


def numbers(text: Column) -> Column:
    """Distinct numbers with their units, without separators; placeholders in brackets have none."""
    found = all_of(F.regexp_replace(text, PLACEHOLDER, " "), NUMBER)
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(F.regexp_replace(n, r"[\s,$£€]", ""), r"\++$", "")))


def violations(new: Column, source: Column, profile: Column) -> Column:
    """array<struct<kind, value>> of what `new` claims and neither its source nor (numbers apart) the profile supports."""
    allowed = F.concat_ws("\n", source, profile)
    fresh = lambda pattern: F.array_except(all_of(new, pattern), all_of(allowed, pattern))
    unsupported = F.filter(F.array_except(numbers(new), numbers(source)), lambda n: ~n.rlike(f"^{YEAR}$"))
    degree = F.when((F.size(all_of(new, DEGREE)) > 0) & (F.size(all_of(allowed, DEGREE)) == 0), F.array(F.lit("degree"))).otherwise(F.array().cast("array<string>"))
    of = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    return F.concat(of("number", unsupported), of("year", fresh(YEAR)), of("degree", degree), of("title", fresh(TITLE)))


def sanitized(text: Column) -> Column:
    return F.regexp_replace(text, INJECTION, "[removed instruction-like text]")


def strange_names(new: Column, allowed: Column, known: list[str]) -> Column:
    """Proper names of a text whose words the allowed text doesn't have; `known` are skills' names in lower case."""
    told = F.array_distinct(F.regexp_extract_all(F.regexp_replace(new, PLACEHOLDER, " "), F.lit(PROPER), F.lit(1)))
    plain = lambda t: F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"\s+", " ")
    words = lambda t: F.regexp_extract_all(t, F.lit("[a-z0-9&]+"), F.lit(0))

    def strange(name: Column, text: Column, own: Column) -> Column:
        parts = F.split(name, r"\s+")
        usual = parts[0].isin(*COMMON_CAPITALS) | (F.length(name) < 3) | (F.array_contains(F.lit(known).cast("array<string>"), F.lower(name)) if known else F.lit(False)) | F.contains(text, plain(name))
        return ~usual & ~F.forall(F.filter(parts, lambda p: ~p.rlike(ACRONYM)), lambda p: F.array_contains(own, F.lower(p)))

    return let(plain(allowed), lambda text: let(words(text), lambda own: F.filter(told, lambda n: strange(n, text, own))))


def verified_claim(new: Column, profile: Column, source: Column, facts: Column, taxonomy: Taxonomy, implied: Column | None = None) -> Column:
    """array<struct<kind, value>> of what rewritten text claims beyond the profile, its source and a person's facts.

    Skills (less those that `implied`, an array, allows), numbers, years, degrees, title words and proper names.
    """
    allowed = F.concat_ws("\n", profile, source, facts)
    skills = lambda t: wanted_or_not(hits_in(words_of(t), taxonomy))
    fresh = F.array_except(skills(new), skills(allowed))
    fresh = F.array_except(fresh, implied) if implied is not None else fresh
    of = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    known = sorted({s.lower() for _, s, _ in taxonomy.entries} | {a for a, _, _ in taxonomy.entries})
    return F.concat(of("skill", fresh), violations(new, F.concat_ws("\n", source, facts), profile), of("name", strange_names(new, allowed, known)))


def wanted_or_not(hits: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["skill"])))


def numbers_supported(answer: Column, evidence: Column) -> Column:
    """Sorted numbers of an answer that its evidence doesn't have, with or without a percent sign; the numbering of lists is none."""
    bare = lambda n: F.regexp_replace(n, "%$", "")
    known = lambda e: F.array_union(e, F.transform(e, bare))
    body = F.regexp_replace(answer, r"(?m)^\s*\d{1,2}[.)]\s", " ")
    return F.array_sort(let(known(numbers(evidence)), lambda e: F.filter(numbers(body), lambda n: ~F.array_contains(e, n) & ~F.array_contains(e, bare(n)) & (bare(n) != ""))))


def loose_json(text: Column) -> Column:
    """What stands from the first brace to the last, if it is JSON, else null."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def request_key(parts: dict[str, Column]) -> Column:
    """A digest of named values that doesn't depend on their order: the key of a cached search or call."""
    return F.sha2(F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts)))), 256)
