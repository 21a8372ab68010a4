"""Evaluation suites: loading cases, running them and aggregating results as one typed interface, each suite one grouped aggregate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("met", "partial", "missing")
CREDIT = ("met", "partial")


def rate(hits: Column, of: Column) -> Column:
    """Share of the rows that are `of` and also `hits`, to four places; null for none."""
    return F.round(F.try_divide(F.count_if(of & hits), F.count_if(of)), 4)


def measured(hits: Column, found: Column, wanted: Column) -> dict[str, Column]:
    """precision, recall and f1 of sums of hits, of what was found and of what is wanted; an empty denominator counts as 1."""
    part = lambda a, b: F.when(b == 0, 1.0).otherwise(a / b)
    p, r = part(hits, found), part(hits, wanted)
    return {"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)), 4)}


@dataclass(frozen=True)
class Suite:
    """load(spark, sf_dir): the cases. run(cases): a row for each result. metrics: name and aggregate over the results.

    grouped: for metrics over groups of results (as repeated runs of a case), what the groups are and their own aggregates,
    over which `group_metrics` are then taken.
    """

    name: str
    description: str
    load: Callable[..., DataFrame]
    run: Callable[[DataFrame], DataFrame]
    metrics: dict[str, Column]
    groups: tuple[str, ...] = ()
    per_group: dict[str, Column] = field(default_factory=dict)
    group_metrics: dict[str, Column] = field(default_factory=dict)


def reported(suite: Suite, spark, sf_dir: str) -> DataFrame:
    """suite, metric, value: one row for each metric; null where there was nothing to measure."""
    results = suite.run(suite.load(spark, sf_dir))
    parts = [(results, suite.metrics)]
    if suite.groups:
        parts.append((results.groupBy(*suite.groups).agg(*(c.alias(n) for n, c in suite.per_group.items())), suite.group_metrics))
    out = None
    for rows, metrics in parts:
        if metrics:
            one = rows.agg(*(c.cast("double").alias(n) for n, c in metrics.items()))
            told = one.select(F.lit(suite.name).alias("suite"), F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics))))
            out = told if out is None else out.unionByName(told)
    return out


# --- suites' aggregates over results of one shape -------------------------------------------------------------------------


def verifier(load, run) -> Suite:
    """Results (case_id, requirement, gold, assessed, det, raw, final, verified, quote, quote_found): judgments against gold."""
    a, claims = F.col("assessed"), F.col("assessed") & F.col("raw").isin(*CREDIT)
    quoted, lacking = claims & (F.col("quote") != ""), a & (F.col("gold") == "missing")
    same = lambda c: F.col(c) == F.col("gold")
    metrics = {
        "gold_requirements": F.count("*"), "gold_coverage": rate(a, F.lit(True)), "rules_accuracy": rate(same("det"), a), "raw_accuracy": rate(same("raw"), a), "final_accuracy": rate(same("final"), a),
        "hallucinated_quote_rate": rate(~F.col("quote_found"), quoted), "irrelevant_quote_rate": rate(F.col("quote_found") & ~F.col("verified"), quoted), "unquoted_claim_rate": rate(claims & (F.col("quote") == ""), a),
        "raw_overcredit_rate": rate(F.col("raw").isin(*CREDIT), lacking), "final_overcredit_rate": rate(F.col("final").isin(*CREDIT), lacking),
        "ai_added_false_credit": F.count_if(lacking & ~F.col("det").isin(*CREDIT) & F.col("final").isin(*CREDIT)),
        "missed_credit_rate": rate(F.col("final") == "missing", a & (F.col("gold") == "met")), "unsupported_quote_accepted": F.count_if(a & F.col("verified") & ~F.col("quote_found")),
        "ai_lift": F.round(rate(same("final"), a) - rate(same("det"), a), 4),
    }
    for s in STATUSES:  # f1 of a status: 2 hits over what was said and what is gold
        metrics[f"f1_{s}"] = F.round(F.try_divide(2 * F.count_if(a & (F.col("final") == s) & (F.col("gold") == s)), F.count_if(a & (F.col("final") == s)) + F.count_if(a & (F.col("gold") == s))), 4)
    return Suite("deep_verifier", "judgments of requirements against gold labels", load, run, metrics)


def consistency(load, run, repeats: int) -> Suite:
    """Results as of `verifier` with a verdict, of `repeats` runs of each case: how often runs agree."""
    full = F.col("n") == repeats
    return Suite(
        "consistency", "agreement of repeated runs", load, run, {"repeats": F.lit(repeats).cast("long") + 0 * F.count("*")}, ("case_id", "requirement"),
        {"n": F.count_if("assessed"), "raws": F.count_distinct(F.when(F.col("assessed"), F.col("raw"))), "finals": F.count_distinct(F.when(F.col("assessed"), F.col("final"))), "verdicts": F.count_distinct("verdict")},
        {"requirements": F.count_if(full), "raw_agreement": rate(F.col("raws") == 1, full), "final_agreement": rate(F.col("finals") == 1, full), "verdict_flip_rate": rate(F.col("verdicts") > 1, F.lit(True))},
    )


def extractor(load, run) -> Suite:
    """Results (tp, fp, fn, model_items, dropped, used, split) of a case each: extracted lines against gold lines."""
    sums = lambda c, where=None: F.coalesce(F.sum(F.when(where, F.col(c)) if where is not None else F.col(c)), F.lit(0))
    tp, fp, fn = sums("tp"), sums("fp"), sums("fn")
    hold = F.col("split") == "holdout"
    h = [sums(c, hold) for c in ("tp", "fp", "fn")]
    metrics = measured(tp, tp + fp, tp + fn) | {
        "holdout_f1": F.when(F.count_if(hold) > 0, measured(h[0], h[0] + h[1], h[0] + h[2])["f1"]), "ungrounded_item_rate": F.round(F.try_divide(sums("dropped"), sums("model_items")), 4),
        "fallback_to_rules_rate": rate(~F.col("used"), F.lit(True)), "cases": F.count("*"),
    }
    return Suite("extractor", "extracted requirement lines against gold lines", load, run, metrics)


def as_markdown(report: DataFrame) -> DataFrame:
    """suite and text: a Markdown table of each suite's metrics by name; n/a for null. Suites have few metrics."""
    number = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", F.col("value")), r"0+$", ""), r"\.$", "")
    line = F.concat(F.lit("| "), "metric", F.lit(" | "), F.coalesce(F.when(F.col("value").isNotNull(), number), F.lit("n/a")), F.lit(" |"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("metric", line.alias("line")))), lambda x: x["line"])
    return report.groupBy("suite").agg(F.concat(F.lit("## "), F.first("suite"), F.lit("\n\n| metric | value |\n|-|-|\n"), F.array_join(listed, "\n"), F.lit("\n")).alias("text"))
