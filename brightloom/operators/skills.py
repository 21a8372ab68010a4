"""Skills named in texts: one pass of an automaton of all aliases over a text's words, then context and negation in the row.

A text is cut into words once. An Aho-Corasick automaton, which each worker builds once from a taxonomy of a checked size,
finds every run of words that is an alias in one pass, so no row is multiplied, nothing is shuffled, and cost follows the
text whatever the number of aliases. A taxonomy beyond that size is joined by equality instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import of_each_text
from ..functions.text import let
from ..functions.values import CLAUSE_WORDS, CONTEXT_WORDS, NEGATIONS, SEASON_YEAR, SOFT_CATEGORY

WORD = r"\.?[a-z0-9+#_]+(?:\.[a-z0-9+#_]+)*(?:'t)?|[.;:!?\n•]"
MARKS = [".", ";", ":", "!", "?", "\n", "•"]
NEAR = 6  #: words before a mention in which a negation counts
NOT_ASKED = r"^(\S+ ){0,4}?((is|are) )?(not|\S*n't) (required|needed|necessary|mandatory|a requirement)( |$)"
SEASON_END = r"(?i)\b(?:spring|summer|fall|autumn|winter)(?:\s+(?:term|semester|of))?\s*$"  #: a line that a year on the next one may follow
HITS = "array<struct<skill: string, line: int, negated: boolean>>"
LINE_HITS = "struct<hits: array<struct<skill: string, negated: boolean>>, open: boolean>"
FOUND = "array<struct<at: int, n: int, skill: string, context: array<string>>>"
MOST_ALIASES = 200_000  #: rows of a taxonomy that goes to all workers
MOST_LETTERS = 16 << 20  #: and the letters of its aliases, skills and context words
_automata: dict[str, ahocorasick.Automaton] = {}  # of a worker, by the taxonomy's digest; outlives a task


@dataclass(frozen=True)
class Taxonomy:
    """Entries of (alias, skill, context words or None); categories and related skills by skill."""

    entries: tuple[tuple[str, str, tuple[str, ...] | None], ...]
    categories: tuple[tuple[str, str], ...] = ()

    @classmethod
    def of(cls, rows: Iterable[tuple]) -> Taxonomy:
        """From rows (skill, category, alias, context); an alias with context counts only near one of these words."""
        rows = [tuple(r) for r in rows]
        entries = tuple(sorted({(a.lower(), s, tuple(c) if c else None) for s, _, a, c in rows}, key=str))
        return cls(entries, tuple(sorted({(s, c) for s, c, _, _ in rows})))

    @classmethod
    def load(cls, table: DataFrame) -> Taxonomy:
        """From a table (skill, category, alias, context array<string>) within MOST_ALIASES and MOST_LETTERS; a larger one is refused."""
        rows = table.select("skill", "category", "alias", "context").where("skill is not null and alias is not null")
        letters = F.length("skill") + F.length("alias") + F.coalesce(F.length(F.array_join("context", "")), F.lit(0))
        n, size = rows.agg(F.count("*"), F.coalesce(F.sum(letters), F.lit(0))).first()
        if n > MOST_ALIASES or size > MOST_LETTERS:
            raise ValueError(f"{n} aliases of {size} letters, more than {MOST_ALIASES} or {MOST_LETTERS}: use mentions_joined")
        return cls.of(rows.collect())

    @property
    def soft(self) -> list[str]:
        return [s for s, c in self.categories if c == SOFT_CATEGORY]


def words_of(text: Column) -> Column:
    """Words in lower case, dots inside kept (node.js, .net), and the marks that end a clause; dates of seasons are left out."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), SEASON_YEAR, " ")), F.lit(WORD), F.lit(0))


def run_of(alias: Column) -> Column:
    """An alias as the run of words that it is in texts, without marks."""
    return F.array_join(F.filter(words_of(alias), lambda w: ~w.isin(*MARKS)), " ")


def ends_clause(word: Column) -> Column:
    return word.isin(*MARKS, *CLAUSE_WORDS)


def upto_break(words: Column) -> Column:
    """The words ahead of the first that ends a clause."""
    at = lambda x: F.array_position(F.transform(x, ends_clause), True).cast("int")
    return let(words, lambda x: let(at(x), lambda k: F.when(k > 0, F.slice(x, 1, k - 1)).otherwise(x)))


def negated(words: Column, at: Column, n: Column) -> Column:
    """Whether the mention of n words from place `at` on is ruled out by its clause."""
    before = upto_break(F.reverse(F.slice(words, F.greatest(F.lit(1), at - NEAR), F.least(F.lit(NEAR), at - 1))))
    after = F.array_join(upto_break(F.slice(words, at + n, 8)), " ")
    return F.exists(before, lambda w: w.isin(*NEGATIONS) | w.endswith("n't")) | after.rlike(NOT_ASKED)


def around(words: Column, at: Column, n: Column) -> Column:
    """The CONTEXT_WORDS nearest words on each side of a mention, marks not counted."""
    told = lambda x: F.filter(x, lambda w: ~w.isin(*MARKS))
    before = told(F.reverse(F.slice(words, F.greatest(F.lit(1), at - 2 * CONTEXT_WORDS), F.least(F.lit(2 * CONTEXT_WORDS), at - 1))))
    return F.concat(F.slice(before, 1, CONTEXT_WORDS), F.slice(told(F.slice(words, at + n, 2 * CONTEXT_WORDS)), 1, CONTEXT_WORDS))


def runs_in(words: Column, starts: Column, longest: int) -> Column:
    """array<struct<at, n, run>>: from each start the runs of up to `longest` words."""
    size = F.size(words)
    runs = F.transform(starts, lambda at: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), size - at + 1)), lambda n: F.struct(at.alias("at"), n.alias("n"), F.array_join(F.slice(words, at, n), " ").alias("run"))))
    return F.flatten(runs)


def automaton_of(runs: list[str]) -> ahocorasick.Automaton:
    """Finds runs between blanks; each gives its number of words and the places of its entries in `runs`."""
    places: dict[str, list[int]] = {}
    for k, run in enumerate(runs):
        places.setdefault(run, []).append(k)
    found = ahocorasick.Automaton()
    for run, own in places.items():
        if run:
            found.add_word(f" {run} ", (run.count(" ") + 1, own))
    found.make_automaton()
    return found


def finder(taxonomy: Taxonomy):
    """A column function: of words joined by blanks, each run that is an alias, once for each entry of that alias."""
    runs, skills, contexts = [_run(a) for a, _, _ in taxonomy.entries], [s for _, s, _ in taxonomy.entries], [list(c or ()) for _, _, c in taxonomy.entries]
    name = hashlib.blake2b(repr(taxonomy.entries).encode(), digest_size=16).hexdigest()

    @F.arrow_udf(FOUND)
    def found(lines: pa.Array) -> pa.Array:
        automaton = _automata.get(name)
        if automaton is None:
            automaton = _automata[name] = automaton_of(runs)
        ends, at, size, entry = [0], [], [], []
        for line in lines.to_pylist():
            if line and len(automaton):
                line = f" {line} "
                words = upto = 0
                for end, (n, own) in automaton.iter(line):  # ends never go back, so blanks are counted once
                    words += line.count(" ", upto, end)
                    upto = end
                    for k in own:
                        at.append(words - n + 1)
                        size.append(n)
                        entry.append(k)
            ends.append(len(at))
        entry = np.array(entry, np.int64)
        fields = [pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(skills, pa.string()).take(pa.array(entry)), pa.array(contexts, pa.list_(pa.string())).take(pa.array(entry))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["at", "n", "skill", "context"]))

    return found


def hits_in(words: Column, taxonomy: Taxonomy) -> Column:
    """array<struct<skill, line, negated>>: every mention in `words` (of `words_of`), with the line that it is on, from 0.

    Not for use within a lambda, as the automaton runs in an Arrow batch. Null words have no hits.
    """
    if not taxonomy.entries:
        return F.array().cast(HITS)
    both = F.struct(words.alias("w"), finder(taxonomy)(F.array_join(words, " ")).alias("found"))
    fits = lambda w, r: (F.size(r["context"]) == 0) | F.arrays_overlap(around(w, r["at"], r["n"]), r["context"])
    told = lambda w, r: F.struct(r["skill"].alias("skill"), F.size(F.filter(F.slice(w, 1, r["at"]), lambda x: x == "\n")).alias("line"), negated(w, r["at"], r["n"]).alias("negated"))
    return let(both, lambda x: F.transform(F.filter(x["found"], lambda r: fits(x["w"], r)), lambda r: told(x["w"], r)))


def hits_on_line(line: Column, taxonomy: Taxonomy) -> Column:
    """struct<hits: array<struct<skill, negated>>, open> of one line by itself.

    Aliases and clauses end with the line, so these are the hits that a text has on it, unless `open` says that other lines
    may add to them: a mention whose context isn't on the line, or a season whose year may be on the next one. Not for use
    within a lambda.
    """
    ends = F.coalesce(line.rlike(SEASON_END), F.lit(False))
    if not taxonomy.entries:
        return F.struct(F.array().alias("hits"), F.lit(False).alias("open")).cast(LINE_HITS)
    both = F.struct(words_of(line).alias("w"), finder(taxonomy)(F.array_join(words_of(line), " ")).alias("found"))
    fits = lambda w, r: (F.size(r["context"]) == 0) | F.arrays_overlap(around(w, r["at"], r["n"]), r["context"])
    met = lambda x: F.transform(x["found"], lambda r: F.struct(r["skill"].alias("skill"), fits(x["w"], r).alias("fits"), negated(x["w"], r["at"], r["n"]).alias("negated")))
    told = lambda m: F.struct(F.transform(F.filter(m, lambda h: h["fits"]), lambda h: F.struct(h["skill"].alias("skill"), h["negated"].alias("negated"))).alias("hits"), (ends | F.exists(m, lambda h: ~h["fits"])).alias("open"))
    return let(both, lambda x: let(met(x), told)).cast(LINE_HITS)


def _run(alias: str) -> str:
    import re

    return " ".join(w for w in re.findall(WORD, alias.lower()) if w not in MARKS)


def skills_of(hits: Column) -> Column:
    """array<struct<skill, negated>> in order of skill: each once, negated if every mention is."""
    names = lambda h: F.array_sort(F.array_distinct(F.transform(h, lambda x: x["skill"])))
    return let(hits, lambda h: F.transform(names(h), lambda s: F.struct(s.alias("skill"), (~F.exists(h, lambda x: (x["skill"] == s) & ~x["negated"])).alias("negated"))))


def wanted_of(hits: Column) -> Column:
    """Sorted skills that some mention asks for."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(hits, lambda h: ~h["negated"]), lambda h: h["skill"])))


def ruled_out_of(hits: Column) -> Column:
    """Sorted skills all of whose mentions are negated."""
    return let(hits, lambda h: F.array_except(F.array_sort(F.array_distinct(F.transform(h, lambda x: x["skill"]))), wanted_of(h)))


def mentions(rows: DataFrame, taxonomy: Taxonomy, text: str = "description") -> DataFrame:
    """id, skill, negated: each skill that a row's text names; negated if every mention is. Null texts name none."""
    def named(texts: DataFrame) -> DataFrame:
        words = texts.select("_text", words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
        return words.select("_text", F.inline(skills_of(hits_in(F.col("w"), taxonomy))))

    return of_each_text(rows.select("id", text), [text], named)


MOST_FIRSTS = 1_000_000  #: first words of aliases that go to all workers, so that runs which begin like none are never made


def starts_of(words: Column, firsts: list[str]) -> Column:
    """Places, from 1, of the words that begin some alias. Not for use within a lambda."""
    known = frozenset(firsts)

    @F.arrow_udf("array<int>")
    def found(rows: pa.Array) -> pa.Array:
        return pa.array([[k for k, w in enumerate(row or [], 1) if w in known] for row in rows.to_pylist()], pa.list_(pa.int32()))

    return found(words)


def mentions_joined(rows: DataFrame, aliases: DataFrame, text: str = "description", longest: int = 8, most_firsts: int = MOST_FIRSTS) -> DataFrame:
    """`mentions` for a taxonomy of any size: runs of up to `longest` words are joined to aliases (skill, alias, context) by equality.

    Runs are made only where a word begins some alias, as far as these words are at most `most_firsts` (counted); of a
    taxonomy with more every word begins runs.
    """
    known = aliases.select("skill", run_of(F.col("alias")).alias("run"), "context").where("run <> ''").distinct()
    heads = known.select(F.element_at(F.split("run", " "), 1).alias("w")).distinct().limit(most_firsts + 1).collect()
    few = len(heads) <= most_firsts
    starts = starts_of(F.col("w"), [r.w for r in heads]) if few else F.filter(F.sequence(F.lit(1), F.size("w")), lambda at: ~F.element_at("w", at).isin(*MARKS))
    runs = F.transform(runs_in(F.col("w"), F.col("starts"), longest), lambda r: F.struct(r["run"].alias("run"), around(F.col("w"), r["at"], r["n"]).alias("near"), negated(F.col("w"), r["at"], r["n"]).alias("negated")))

    def named(texts: DataFrame) -> DataFrame:
        words = texts.select("_text", words_of(F.col(text)).alias("w")).where(F.size("w") > 0).withColumn("starts", starts).where(F.size("starts") > 0)
        met = words.select("_text", F.inline(runs)).join(known, "run").where("context is null or size(context) = 0 or arrays_overlap(near, context)")
        return met.groupBy("_text", "skill").agg(F.bool_and("negated").alias("negated"))

    return of_each_text(rows.select("id", text), [text], named).groupBy("id", "skill").agg(F.bool_and("negated").alias("negated"))


def canonical(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """`names` (name) with skill: the one of that name or alias in any case, or null. Of an alias of several skills the first by name."""
    low = lambda c: F.lower(F.trim(F.col(c)))
    own = aliases.select(low("skill").alias("k"), "skill", F.lit(0).alias("rank")).union(aliases.select(low("alias"), "skill", F.lit(1)))
    known = own.groupBy("k").agg(F.min(F.struct("rank", "skill")).alias("best"))
    return names.join(known, low("name") == F.col("k"), "left").select(*names.columns, F.col("best.skill").alias("skill"))


def categorised(skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """`skills` (skill) with category, `Other` for unknown ones."""
    known = aliases.groupBy("skill").agg(F.min("category").alias("category"))
    return skills.join(known, "skill", "left").withColumn("category", F.coalesce("category", F.lit("Other")))
