"""More text functions as column expressions: names and slugs, masks, labels, times, costs, set likeness, a hashed embedding."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let
from .values import ROLE_WORD, STOP, STOP_EMBED

# --- fixed values: endings, marks, words, prices' units ------------------------------------------------------------------
EMBED_ENDINGS = ("ations", "ation", "ings", "ing", "ies", "es", "ed", "s", "al", "ly")
EVIDENCE_ENDINGS = ("ations", "ation", "ments", "ment", "ings", "ing", "ers", "er", "ies", "es", "ed", "s")
LOW_INFORMATION = (
    "experience year years work strong skill skills ability abilities knowledge team role using build building develop development conduct conducting perform provide demonstrated proven "
    "track record subject related field similar equivalent hands solid excellent deep good familiar familiarity proficiency proficient understanding minimum least plus preferred required "
    "current active level other including"
).split()
COMPANY_FORMS = r"\b(inc|llc|ltd|limited|gmbh|corp|corporation|co|plc|sa|ag|bv|the)\b\.?"
SLUG = r"^[a-z0-9][a-z0-9._-]{1,60}$"
ACRONYMS = "ml ai bi ui ux rn sre qa it hr seo etl".split()
KEYS = r"\b(sk-[A-Za-z0-9_-]{6,}|sk-ant-[A-Za-z0-9_-]{6,}|cvx_[A-Za-z0-9_-]{6,})"
TRUNCATED = "\n…[truncated]"
HEADER_MARK = r"(?i)\s+(?:[|·•–—@]|-|at)\s+|,\s*"
UNACCENTED = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def cut_ending(word: Column, endings, rest: int) -> Column:
    """The word without the first of the endings that leaves at least `rest` letters."""
    cut = F
    for e in endings:
        cut = cut.when(word.endswith(e) & (F.length(word) >= len(e) + rest), F.substring(word, F.lit(1), F.length(word) - len(e)))
    return cut.otherwise(word)


def evidence_stems(text: Column) -> Column:
    """Distinct stems, of five letters at most, of the words that say something."""
    words = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z0-9+#\-]{1,}"), F.lit(0)), lambda w: F.btrim(w, F.lit("-")))
    told = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*LOW_INFORMATION) & ~w.isin(*STOP))
    return F.array_distinct(F.transform(told, lambda w: F.substring(cut_ending(w, EVIDENCE_ENDINGS, 3), 1, 5)))


def company_words(name: Column) -> Column:
    """A company's name in plain lower-case words without legal forms."""
    plain = F.regexp_replace(F.translate(F.lower(name), *UNACCENTED), r"[^\x00-\x7f]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, COMPANY_FORMS, " "), "[^a-z0-9]+", " "))


def slug_candidates(name: Column) -> Column:
    """At most five slugs under which a company may have a board: joined, hyphened, its first word, with inc, with hq."""

    def of(n: Column) -> Column:
        parts = F.split(n, " ")
        joined = F.array_join(parts, "")
        some = F.array(joined, F.array_join(parts, "-"), F.element_at(parts, 1), F.when(F.size(parts) > 1, F.concat(joined, F.lit("inc"))), F.concat(joined, F.lit("hq")))
        return F.slice(F.filter(F.array_distinct(F.array_compact(some)), lambda s: s.rlike(SLUG)), 1, 5)

    return F.when(company_words(name) == "", F.array().cast("array<string>")).otherwise(let(company_words(name), of))


def city_of(location: Column) -> Column:
    """The city as tables show it."""
    return F.coalesce(F.nullif(F.trim(F.element_at(F.split(F.coalesce(location, F.lit("")), r"[,(;|]"), 1)), F.lit("")), F.lit("Unspecified"))


def squeezed(text: Column) -> Column:
    """Lower case, white space made one."""
    return F.regexp_replace(F.lower(text), r"\s+", " ")


def trimmed(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(TRUNCATED))).otherwise(text)


def masked(text: Column, secret: str = "") -> Column:
    """The text without API keys, or a given secret of six letters or more."""
    plain = F.replace(text, F.lit(secret), F.lit("***")) if len(secret) >= 6 else text
    return F.regexp_replace(plain, KEYS, "***")


def title_case(text: Column) -> Column:
    return F.array_join(F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.when(w.isin(*ACRONYMS), F.upper(w)).otherwise(F.initcap(w))), " ")


def file_slug(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-")


def label_value(text: Column) -> Column:
    """A value as a metric's label holds it."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", " ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def header_parts(text: Column) -> Column:
    """struct<title, company> of a role's heading; a role word in the second part alone swaps them."""
    parts = F.filter(F.transform(F.split(text, HEADER_MARK), lambda p: F.btrim(p, F.lit(" ,|-–—"))), lambda p: p != "")

    def told(p: Column) -> Column:
        a, b = F.coalesce(F.get(p, F.lit(0)), F.lit("")), F.coalesce(F.get(p, F.lit(1)), F.lit(""))
        swap = b.rlike(ROLE_WORD) & ~a.rlike(ROLE_WORD)
        return F.struct(F.when(swap, b).otherwise(a).alias("title"), F.when(swap, a).otherwise(b).alias("company"))

    return let(parts, told)


def echoes(output: Column, instructions: Column, run: int = 7) -> Column:
    """Whether a text repeats any `run` words in a row of the instructions."""
    words = lambda t: F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z']+"), F.lit(0))
    told = lambda out, w: F.exists(F.sequence(F.lit(1), F.size(w) - run + 1), lambda k: F.contains(out, F.array_join(F.slice(w, k, run), " ")))
    return let(F.array_join(words(output), " "), lambda out: let(words(instructions), lambda w: F.when(F.size(w) >= run, told(out, w)).otherwise(False)))


def relative_age(posted: Column, now: Column) -> Column:
    """today, 1d to 29d, months or years since a date; null if it is unknown."""
    days = F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(posted.cast("timestamp"))) / 86400)
    told = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(days < 1, "today").when(days < 30, told(days, "d")).when(days < 365, told(F.floor(days / 30), "mo")).when(days.isNotNull(), told(F.floor(days / 365), "y"))


def month_label(index: Column) -> Column:
    """YYYY-MM of year * 12 + month - 1."""
    return F.format_string("%04d-%02d", F.expr("cast(0 as int)") + F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"))


def months_between(start: Column, end: Column, now: Column) -> Column:
    """Months, both ends counted, of two YYYY-MM labels, the end possibly `present`; 0 for what can't be read."""
    index = lambda s: F.substring(s, 1, 4).try_cast("int") * 12 + F.substring(s, 6, 2).try_cast("int") - 1
    last = F.when(end == "present", now).otherwise(index(end))
    return F.coalesce(F.greatest(F.lit(0), last - index(start) + 1), F.lit(0)).cast("int")


def expiry(owner: Column, base: Column, anonymous_days: int = 7, user_days: int = 365) -> Column:
    """When an owner's rows expire: those of users (u:...) later."""
    days = F.when(F.startswith(owner, F.lit("u:")), user_days).otherwise(anonymous_days)
    return F.timestamp_micros(F.unix_micros(base.cast("timestamp")) + days.cast("long") * 86_400_000_000)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def containment(a: Column, b: Column) -> Column:
    """Share of the set a that b holds, or null for an empty a."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)))


def cost_usd(prices: Column, inp: Column, out: Column, read: Column, written: Column) -> Column:
    """Dollars of one call, of a struct of prices a million tokens (inp, out, read, written); null without prices."""
    return F.round((inp * prices["inp"] + out * prices["out"] + read * prices["read"] + written * prices["written"]) / 1e6, 6)


def estimated_cost(prices: Column, input_chars: Column, output_tokens: Column, calls: Column, cached_chars: Column) -> Column:
    """Dollars of `calls` calls that share a cached prefix, four characters a token."""
    tokens = lambda chars: F.floor(chars / 4)
    zero = F.lit(0)
    first = cost_usd(prices, tokens(input_chars), output_tokens, zero, tokens(cached_chars))
    rest = cost_usd(prices, tokens(input_chars - cached_chars), output_tokens, tokens(cached_chars), zero)
    return F.round(first + rest * F.greatest(F.lit(0), calls - 1), 4)


def clamped(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def cosine(a: Column, b: Column) -> Column:
    """Of two unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def semantic_credit(sim: Column, floor: float = 0.20, span: float = 0.35) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (sim - floor) / span))


def embedded(words: Column, dim: int = 512) -> Column:
    """Unit vectors of texts given as arrays of words: words, pairs and runs of four letters, each hashed to a place and sign.

    Spark has no BLAKE2, so the hashing is done in an Arrow batch; words come from `embed_words`.
    """

    def place(feature: str) -> tuple[int, float]:
        v = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
        return v % dim, 1.0 if v >> 63 else -1.0

    @F.pandas_udf("array<double>")
    def hashed(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            own = list(row) if row is not None else []
            vector = [0.0] * dim
            weighed = [(f"w:{w}", 1.0) for w in own] + [(f"b:{a}_{b}", 0.7) for a, b in zip(own, own[1:], strict=False)]
            weighed += [(f"c:{f'#{w}#'[k : k + 4]}", 0.25) for w in own for k in range(max(1, len(w) - 1))]
            for feature, weight in weighed:
                at, sign = place(feature)
                vector[at] += sign * weight
            norm = sum(x * x for x in vector) ** 0.5 or 1.0
            out.append([x / norm for x in vector])
        return pd.Series(out)

    return hashed(words)


def embed_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9+#]+"), F.lit(0))
    return F.transform(F.filter(words, lambda w: ~w.isin(*sorted(STOP_EMBED))), lambda w: cut_ending(w, EMBED_ENDINGS, 4))
