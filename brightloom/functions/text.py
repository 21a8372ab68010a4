"""Text functions as column expressions: tokens, titles, company and city keys, HTML, dates, money, identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import LEGAL_FORMS, NOISE, PHRASES, ROLE_NOUNS, SYNONYMS

CURRENCY = r"([$£€])\s?(\d[\d,.]*)\s*([kK])?(?:\s*(?:-|–|to)\s*[$£€]?\s?(\d[\d,.]*)\s*([kK])?)?\s*(?:/|per\s+)?(hour|hr|year|yr|annum|month)?"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\d[\d ().-]{7,}\d"
LINK = r"https?://[^\s<>\"')]+"


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often and in whatever lambda the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literals(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def norm_tokens(text: Column) -> Column:
    """Lower-cased tokens with phrases and synonyms made one; null has none."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    for pattern, word in PHRASES:
        plain = F.regexp_replace(plain, pattern, word)
    synonyms = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    return F.transform(F.regexp_extract_all(plain, F.lit("[a-z0-9+#]+"), F.lit(0)), lambda w: F.coalesce(F.try_element_at(synonyms, w), w))


def core_tokens(text: Column) -> Column:
    """Distinct tokens in order, without words that say nothing about the role."""
    return F.array_distinct(F.filter(norm_tokens(text), lambda w: ~w.isin(*NOISE)))


def role_noun(tokens: Column) -> Column:
    """The last role noun, or null."""
    return F.try_element_at(F.filter(tokens, lambda w: w.isin(*ROLE_NOUNS)), F.lit(-1))


def relevance(title: Column, context: Column, wanted: Column) -> Column:
    """0 to 1: how well a title, and weaker its context, hold the core tokens of the wanted title."""

    def fit(s: Column) -> Column:
        tokens, core = s["tokens"], s["core"]
        n = F.size(core)
        hits = F.size(F.array_intersect(core, tokens)) / n
        soft = F.size(F.array_intersect(F.array_except(core, tokens), norm_tokens(context))) / n
        other = role_noun(core) != role_noun(tokens)
        return F.when(n == 0, 1.0).when(other, 0.3).when(hits >= 1, 1.0).otherwise(F.least(F.lit(1.0), hits + 0.4 * soft))

    return let(F.struct(norm_tokens(title).alias("tokens"), core_tokens(wanted).alias("core")), fit)


def norm_company(company: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(company, F.lit(""))), rf"\b({LEGAL_FORMS})\b\.?", "")
    return F.regexp_replace(plain, "[^a-z0-9]", "")


def alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def is_remote(remote: Column, location: Column) -> Column:
    """True, false or null (unknown)."""
    return F.coalesce(remote, F.when(F.contains(F.lower(location), F.lit("remote")), F.lit(True)))


def city_key(location: Column, remote: Column) -> Column:
    low = F.lower(F.coalesce(location, F.lit("")))
    away = F.coalesce(is_remote(remote, location), F.lit(False)) & low.rlike("remote|worldwide|anywhere|global")
    return F.when((F.trim(low) == "") | away, "remote").otherwise(alnum(F.element_at(F.split(low, r"[,;(/|-]"), 1)))


def html_to_text(html: Column) -> Column:
    """Readable lines of an HTML fragment, by expressions alone; text that comes entity-escaped is unescaped first."""
    text = F.coalesce(html, F.lit(""))
    escaped = ~text.rlike("<[a-zA-Z/]") & text.rlike("&lt;")

    def unescaped(x: Column) -> Column:
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            x = F.replace(x, F.lit(entity), F.lit(char))
        return x

    text = F.when(escaped, unescaped(text)).otherwise(text)
    for pattern, new in (
        (r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"(?i)<br\s*/?>", "\n"), (r"(?i)<li\b[^>]*>", "\n• "),
        (r"(?i)</?(p|div|ul|ol|h[1-6]|tr|table|section|article|header|footer|main)\b[^>]*>", "\n"), (r"<[^>]*>", ""),
    ):
        text = F.regexp_replace(text, pattern, new)
    text = F.regexp_replace(unescaped(text), r"[ \t ]+", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"), F.lit(" \n"))


def parse_date(text: Column) -> Column:
    """A timestamp from epoch seconds or milliseconds, ISO date or time, or a feed's date as in RFC 822; null if it is none of these."""
    mail = F.regexp_replace(F.regexp_extract(text, r"(\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} (?:[+-]\d{4}|GMT|UTC|UT|Z))$", 1), "(GMT|UTC|UT|Z)$", "+0000")
    number = F.when(text.rlike(r"^\d{9,14}(\.\d+)?$"), text.try_cast("double"))
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    return F.when(number.isNotNull(), F.timestamp_seconds(seconds)).when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp")).when(mail != "", F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))


def age_hours(posted: Column, now: str) -> Column:
    return (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(posted.cast("timestamp"))) / 3600.0


def salary_point(text: Column) -> Column:
    """struct(currency, yearly): the yearly midpoint of the first amount, or null if it isn't between 8,000 and 1.5 million."""
    group = lambda n: F.regexp_extract(text, CURRENCY, n)
    number = lambda n, k: F.regexp_replace(group(n), r",|\.$", "").try_cast("double") * F.when(k != "", 1000.0).otherwise(1.0)
    low = number(2, group(3))
    high = F.when(group(4) != "", number(4, F.when(group(5) != "", group(5)).otherwise(group(3)))).otherwise(low)
    times = F.when(F.lower(group(6)).isin("hour", "hr"), 2080.0).when(F.lower(group(6)) == "month", 12.0).otherwise(1.0)
    yearly = (low + high) / 2 * times
    return F.when(yearly.between(8000, 1_500_000), F.struct(group(1).alias("currency"), yearly.alias("yearly")))


def urls_in(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(LINK), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")), lambda u: F.length(u) <= 2000))


def without_identity(text: Column) -> Column:
    """The text without e-mail addresses, links and phone numbers."""
    for pattern, mark in ((EMAIL, "[email]"), (LINK, "[link]"), (PHONE, "[phone]")):
        text = F.regexp_replace(text, pattern, mark)
    return text


def csv_safe(text: Column) -> Column:
    """A cell that a spreadsheet doesn't take for a formula."""
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def stem(word: Column) -> Column:
    """One of a few English endings cut from words of more than five letters."""
    word = F.btrim(word, F.lit(".-"))
    cut = F.when(word.endswith("ing"), F.regexp_replace(word, "ing$", "")).when(word.endswith("ies"), F.regexp_replace(word, "ies$", "y"))
    cut = cut.when(word.endswith("es"), F.regexp_replace(word, "es$", "")).when(word.endswith("s"), F.regexp_replace(word, "s$", ""))
    return F.when(F.length(word) > 5, cut.when(word.endswith("ed"), F.regexp_replace(word, "ed$", "")).otherwise(word)).otherwise(word)


def terms(text: Column, stop) -> Column:
    """Stemmed words of more than three letters that carry meaning."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z+#.\-]{2,}"), F.lit(0))
    return F.transform(F.filter(words, lambda w: ~w.isin(*stop) & (F.length(w) > 3)), stem)


def grams(words: Column) -> Column:
    """Words and pairs of neighbours."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))
