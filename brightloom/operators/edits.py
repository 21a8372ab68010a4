"""Ordered edits of texts: each edit sees what the ones before it made, and one whose anchor is gone is told, not lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

EDIT = "struct<kind: string, anchor: string, new: string>"
MARK = "- "  #: ahead of a line put in


def replaced_once(text: Column, anchor: Column, new: Column) -> Column:
    """`text` with the first occurrence of `anchor`, which it holds, replaced."""
    at = F.position(anchor, text)
    return F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(anchor), F.length(text)))


def line_put_in(text: Column, anchor: Column, new: Column) -> Column:
    """`text` with a line behind the one on which the first occurrence of `anchor` ends."""

    def put(eol: Column) -> Column:
        cut = F.when(eol == 0, F.length(text)).otherwise(eol - 1)
        return F.concat(F.substring(text, F.lit(1), cut), F.lit("\n"), new, F.substring(text, cut + 1, F.length(text)))

    ends = F.position(anchor, text) + F.length(anchor)
    return let(F.position(F.lit("\n"), text, ends), put)


def edited(text: Column, edits: Column) -> Column:
    """struct<text, missing> of a text and its array<struct<kind, anchor, new>>, folded in order.

    `replace` changes the first occurrence of its anchor, and does nothing without one; `insert` puts a line behind the one
    with its anchor, or at the end without one. Both are told in `missing`, numbered from 0, if the anchor is blank or no
    longer there. Other kinds do nothing and are told too. A null text is an empty one; null edits are none.
    """
    start = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("missing"))

    def step(acc: Column, e: Column) -> Column:
        new, anchor = F.trim(F.coalesce(e["new"], F.lit(""))), F.coalesce(e["anchor"], F.lit(""))
        there = (anchor != "") & F.contains(acc["text"], anchor)
        line = F.concat(F.lit(MARK), new)
        at_end = F.concat(F.regexp_replace(acc["text"], r"\s+$", ""), F.lit("\n"), line, F.lit("\n"))
        told = F.when((e["kind"] == "replace") & there, replaced_once(acc["text"], anchor, new)).when((e["kind"] == "insert") & there, line_put_in(acc["text"], anchor, line))
        told = told.when(e["kind"] == "insert", at_end).otherwise(acc["text"])
        lost = F.coalesce(~(e["kind"].isin("replace", "insert") & there), F.lit(True))
        return F.struct(told.alias("text"), (acc["n"] + 1).alias("n"), F.when(lost, F.array_append(acc["missing"], acc["n"])).otherwise(acc["missing"]).alias("missing"))

    return F.aggregate(F.coalesce(edits, F.array().cast(f"array<{EDIT}>")), start, step, lambda acc: F.struct(acc["text"].alias("text"), acc["missing"].alias("missing")))


def apply_edits(texts: DataFrame, edits: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`texts` (key, text) edited by rows key, seq, kind, anchor, new of `edits`: key, text, and missing (places in the order of seq).

    Replacements come first and insertions behind them, each in the order of seq, as anchors are those of the text before
    lines were put in. A text's edits are one group; texts without edits stay as they are.
    """
    first = F.when(F.col("kind") == "replace", 0).otherwise(1)
    listed = F.array_sort(F.collect_list(F.struct(first.alias("first"), "seq", "kind", "anchor", "new")))
    own = edits.groupBy(key).agg(F.transform(listed, lambda e: F.struct(e["kind"].alias("kind"), e["anchor"].alias("anchor"), e["new"].alias("new"))).alias("_edits"))
    return texts.join(own, key, "left").withColumn("_e", edited(F.col(text), F.col("_edits"))).select(key, F.col("_e.text").alias(text), "_e.missing")
