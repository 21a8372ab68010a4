"""Measures of predictions against labels, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import ranked, running_before


def ratio(a: Column, b: Column, empty: float | None = 1.0) -> Column:
    return F.when(b == 0, F.lit(empty).cast("double")).otherwise(a / b)


def precision_recall(rows: DataFrame, label: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, precision, recall, f1; an empty denominator counts as 1."""
    counts = rows.agg(F.count_if(label & predicted).alias("tp"), F.count_if(~label & predicted).alias("fp"), F.count_if(label & ~predicted).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    measured = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return measured.withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def average_rank(rows: DataFrame, value: str, out: str) -> DataFrame:
    """`rows` with the rank of `value` from 1, ties sharing their mean: values are counted, ranked by running totals over
    ranges, and the ranks joined back."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    ranks = running_before(counts, [], value, "_n").withColumn(out, F.col("before") + (F.col("_n") + 1) / 2)
    return rows.join(ranks.select(value, out), value)


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    ranked = average_rank(average_rank(rows, a, "_ra"), b, "_rb")
    return ranked.agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))


def reliability(rows: DataFrame, confidence: str, label: Column, bins: int = 10) -> DataFrame:
    """bin, n, confidence, rate for each bin that has rows."""
    k = F.least(F.lit(bins - 1), F.floor(F.col(confidence) * bins)).cast("int")
    return rows.groupBy(k.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg(label.cast("double")).alias("rate"))


def calibration_error(rows: DataFrame, confidence: str, label: Column, bins: int = 10) -> DataFrame:
    told = reliability(rows, confidence, label, bins)
    return told.agg((F.sum(F.col("n") * F.abs(F.col("rate") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n and Cohen's kappa of two labels."""
    joint = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    n = joint.agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left = joint.groupBy(F.col(a).alias("v")).agg(F.sum("n").alias("na"))
    right = joint.groupBy(F.col(b).alias("v")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "v").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("c"))
    po, pe = F.col("same") / F.col("total"), F.col("c") / (F.col("total") * F.col("total"))
    return n.crossJoin(chance).select(F.col("total").alias("n"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def logistic(rows: DataFrame, x: str, label: Column, rounds: int = 25) -> tuple[float, float]:
    """(intercept, slope) of the likeliest logistic curve of a binary label over `x`, by Newton's steps.

    Rows are counted for each value of `x` first. A step is one aggregate of those counts; the driver sees five sums.
    A small ridge keeps the curve finite where `x` parts the labels.
    """
    counted = rows.groupBy(F.col(x).cast("double").alias("x")).agg(F.count("*").alias("n"), F.count_if(label).alias("k")).where("x is not null").persist()
    a = b = 0.0
    try:
        for _ in range(rounds):
            p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
            w, miss = F.col("n") * p * (1 - p), F.col("k") - F.col("n") * p
            s = counted.agg(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in (miss, miss * F.col("x"), w, w * F.col("x"), w * F.col("x") * F.col("x")))).first()
            g0, g1, h00, h01, h11 = s[0] - 1e-6 * a, s[1] - 1e-6 * b, s[2] + 1e-6, s[3], s[4] + 1e-6
            det = h00 * h11 - h01 * h01
            da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
            a, b = a + da, b + db
            if abs(da) + abs(db) < 1e-10:
                break
    finally:
        counted.unpersist()
    return a, b


def macro_f1(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """classes, macro_f1: mean F1 of the classes that are labelled or predicted at all."""
    joint = rows.groupBy(label, predicted).agg(F.count("*").alias("n"))
    same = F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)
    sides = joint.select(F.col(label).alias("c"), same.alias("tp"), F.col("n").alias("total")).unionByName(joint.select(F.col(predicted).alias("c"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("total")))
    per = sides.where("c is not null").groupBy("c").agg((2 * F.sum("tp") / F.sum("total")).alias("f1"))
    return per.agg(F.count("*").alias("classes"), F.avg("f1").alias("macro_f1"))


def accuracy(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """n, accuracy and mean_error (of numbers); null for no rows."""
    hit = F.col(label).eqNullSafe(F.col(predicted)).cast("double")
    return rows.agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(F.abs(F.col(label) - F.col(predicted)).cast("double")).alias("mean_error"))


def matched_lines(gold: DataFrame, predicted: DataFrame, least: float = 0.6) -> DataFrame:
    """id, n_gold, n_predicted, n_matched of cases (id, array lines of token sets) when each predicted line, in order, takes the first free gold line that is alike.

    Greedy and one to one, by a fold over the lines of one case, which are few.
    """
    from ..functions.phrases import jaccard

    both = gold.select("id", F.col("lines").alias("g")).join(predicted.select("id", F.col("lines").alias("p")), "id", "full")
    empty = F.array().cast("array<array<string>>")
    both = both.select("id", F.coalesce("g", empty).alias("g"), F.coalesce("p", empty).alias("p"))
    fits = lambda taken, p: F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda k: ~F.array_contains(taken, k) & (jaccard(F.get("g", k), p) >= least))
    step = lambda taken, p: F.concat(taken, F.slice(fits(taken, p), 1, 1))
    taken = F.when((F.size("g") > 0) & (F.size("p") > 0), F.aggregate("p", F.array().cast("array<int>"), step)).otherwise(F.array().cast("array<int>"))
    return both.select("id", F.size("g").alias("n_gold"), F.size("p").alias("n_predicted"), F.size(taken).alias("n_matched"))


def leaderboard(runs: DataFrame) -> DataFrame:
    """suite, model, quality, cost_per_100, p95_ms, runs: the newest run of each suite and model, and how many there are."""
    newest = F.max_by(F.struct("quality", F.round(F.try_divide(F.col("cost_usd"), F.col("cases")) * 100, 4).alias("cost_per_100"), "p95_ms"), F.struct("created_at", "run_id"))
    board = runs.groupBy("suite", "model").agg(newest.alias("r"), F.count("*").alias("runs"))
    return board.select("suite", "model", "r.quality", "r.cost_per_100", "r.p95_ms", "runs")


def board_order(board: DataFrame) -> DataFrame:
    """The leaderboard as it is shown, with place: by suite, in a suite the best quality first, unknown ones last; ties by model."""
    return ranked(board, [F.col("suite"), F.coalesce("quality", F.lit(-1.0)).desc(), F.col("model")])


def trend(runs: DataFrame, key: str, most: int = 20) -> DataFrame:
    """The `most` newest values of each key, oldest first: key, n, value."""
    back = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("run_id"))
    last = runs.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= most)
    return last.select(key, F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_back"))).alias("n"), "value")


def regressions(current: DataFrame, baseline: DataFrame, headline: DataFrame) -> DataFrame:
    """key, was, value of metrics (key, value) that are worse than the baseline by more than the headline (key, direction, tolerance) allows."""
    both = headline.join(current.select("key", "value"), "key").join(baseline.select("key", F.col("value").alias("was")), "key")
    worse = F.when(F.col("direction") == "+", F.col("was") - F.col("value")).otherwise(F.col("value") - F.col("was"))
    return both.where(worse > F.col("tolerance") + 1e-9).select("key", "was", "value")


def flattened(results: DataFrame) -> DataFrame:
    """key (suite.metric) and value of results (suite, metrics map)."""
    return results.select("suite", F.explode("metrics").alias("m", "value")).select(F.concat_ws(".", "suite", "m").alias("key"), "value")


def label_agreement(labels: DataFrame) -> DataFrame:
    """item, models, distinct, majority, disagree, of labels (item, model, label); ties go to the first label by name."""
    counts = labels.groupBy("item", "label").agg(F.count("*").alias("n"))
    most = counts.groupBy("item").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("majority"), F.count("*").alias("distinct"), F.sum("n").alias("models"))
    return most.select("item", "models", "distinct", "majority", (F.col("distinct") > 1).alias("disagree"))


def label_stats(pairs: DataFrame) -> DataFrame:
    """One row of pairs (reviewed, done, n_labels): total, reviewed, queue, double."""
    return pairs.agg(F.count("*").alias("total"), F.count_if("reviewed").alias("reviewed"), F.count_if(~F.col("done")).alias("queue"), F.count_if(F.col("n_labels") >= 2).alias("double"))


def rates(cases: DataFrame, suite: str, flags: list[str]) -> DataFrame:
    """suite, n and the rate of each flag over the cases where it is known (null where it never is), rounded to four places."""
    return cases.groupBy(suite).agg(F.count("*").alias("n"), *(F.round(F.avg(F.col(f).cast("double")), 4).alias(f) for f in flags))


def spend(calls: DataFrame, run: str) -> DataFrame:
    """run, calls, known and cost: null where no call's cost is known."""
    return calls.groupBy(run).agg(F.count("*").alias("calls"), F.count("cost_usd").alias("known"), F.sum("cost_usd").alias("cost"))
