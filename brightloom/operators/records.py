"""The store's operations on tables: upsert, expiry, top-1 per key, anti joins, updates, ordered logs, spans of months."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import durable


def one_each(rows: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """`rows` with one of each key: the one of the largest `order`, then (or without) the last by its columns as JSON. Rows of a null key all stay."""
    last = F.struct(*([order] if order is not None else []), F.to_json(F.struct(*rows.columns)))
    once = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), last).alias("_row"))
    return once.select("_row.*").unionByName(rows.where(F.col(key).isNull()))


def only_once(rows: DataFrame, key: str) -> DataFrame:
    """`one_each` of `rows` from the shared folder: only rows whose key comes again are ordered, and none is if no key does."""
    again = durable(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    if again.isEmpty():
        return rows
    chosen = one_each(rows.join(again, key, "left_semi").select(rows.columns), key)
    return durable(rows.join(again, key, "left_anti").select(rows.columns).unionByName(chosen))


def upsert(stored: DataFrame, arriving: DataFrame, key: str, keep_first: list[str], keep_if_null: list[str], order: Column | None = None) -> DataFrame:
    """`stored` with `arriving` rows put in: `keep_first` columns stay as first stored, `keep_if_null` where the new one is null.

    A key is one row in the result, however often it arrives or is stored: `one_each` chooses, by `order`. Rows of a null
    key match none and stay.
    """
    a, b = one_each(stored, key).alias("a"), one_each(arriving, key, order).alias("b")
    new = F.col(f"b.{key}").isNotNull()

    def pick(c: str) -> Column:
        if c in keep_first:
            return F.coalesce(f"a.{c}", f"b.{c}")
        return F.coalesce(f"b.{c}", f"a.{c}") if c in keep_if_null or c == key else F.when(new, F.col(f"b.{c}")).otherwise(F.coalesce(f"a.{c}", f"b.{c}"))

    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*(pick(c).alias(c) for c in stored.columns))


def latest(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The columns of each key's row with the largest `order`; an aggregate with partial results, not a sort."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def alive(rows: DataFrame, now: str, expires: str = "expires_at") -> DataFrame:
    return rows.where(F.col(expires).isNull() | (F.col(expires) > F.lit(now).cast("timestamp")))


def unseen(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(seen.select(*keys), keys, "left_anti")


def with_room(rows: DataFrame, existing: DataFrame, owner: str, key: str, most: int) -> DataFrame:
    """New rows of each owner, as far as the owner has room: at most `most` with those that exist."""
    held = existing.groupBy(owner).agg(F.count("*").alias("_held"))
    new = unseen(rows, existing, [owner, key]).withColumn("_n", F.row_number().over(Window.partitionBy(owner).orderBy(key)))
    return new.join(held, owner, "left").where(F.col("_n") + F.coalesce("_held", F.lit(0)) <= most).drop("_n", "_held")


def numbered(events: DataFrame, run: str, order: list[str], cap: int) -> DataFrame:
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(run).orderBy(*order))).where(F.col("seq") <= cap)


def changes(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before it of the same key; the first always."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_before", before).where(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def merged_months(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """key, months: length of the union of month ranges (inclusive), where ranges that touch are one."""
    rows = spans.select(key, F.col(start).alias("s"), F.col(end).alias("e"))
    w = Window.partitionBy(key).orderBy("s", "e")
    upto = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(upto.isNull() | (F.col("s") > upto + 1), 1).otherwise(0)
    islands = rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans_ = islands.groupBy(key, "island").agg((F.max("e") - F.min("s") + 1).alias("m"))
    return spans_.groupBy(key).agg(F.sum("m").alias("months"))


def reassigned(rows: DataFrame, owner: str, old: Column, new: str) -> DataFrame:
    return rows.withColumn(owner, F.when(F.col(owner).eqNullSafe(old), F.lit(new)).otherwise(F.col(owner)))


def sampled(rows: DataFrame, key: str, always: DataFrame, rate: float, salt: str) -> DataFrame:
    """All rows whose key is in `always`, and a share of the rest that depends on the key alone; with the reason."""
    marked = rows.join(always.select(key).distinct().withColumn("_a", F.lit(True)), key, "left")
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") < int(rate * (1 << 32))
    reason = F.when(F.col("_a"), "disagreement").when(drawn, "sample")
    return marked.withColumn("reason", reason).where("reason is not null").drop("_a")


def nearest_rank(values: Column, p: float) -> Column:
    """The value at place round-half-up(p (n - 1)) of the sorted list `values`."""
    return F.element_at(F.array_sort(values), (F.floor(F.lit(p) * (F.size(values) - 1) + 0.5) + 1).cast("int"))


def iso_week(ts: Column) -> Column:
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))


def purged(tables: dict[str, DataFrame], now: str) -> DataFrame:
    """name, expired: how many rows of each table are no longer alive."""
    counts = [rows.agg(F.lit(name).alias("name"), F.count_if(F.col("expires_at") <= F.lit(now).cast("timestamp")).alias("expired")) for name, rows in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def cascaded(tables: dict[str, DataFrame], root: str, gone: DataFrame, links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """`tables` without the rows of `root` that `gone` (its key) names and all that hang on them.

    `links` are (parent, its key, child, the child's reference), parents first. Rows with a null reference stay.
    """
    removed = {root: tables[root].join(gone, gone.columns, "left_semi")}
    left = {**tables, root: tables[root].join(gone, gone.columns, "left_anti")}
    for parent, key, child, reference in links:
        keys = removed[parent].select(F.col(key).alias(reference)).distinct()
        removed[child] = tables[child].join(keys, reference, "left_semi")
        left[child] = left[child].join(keys, reference, "left_anti")
    return left


def replaced(stored: DataFrame, arriving: DataFrame, keys: list[str]) -> DataFrame:
    """`stored` without the keys that `arriving` has, and all of `arriving`: a search saved anew, a resume, a profile."""
    return unseen(stored, arriving, keys).unionByName(arriving)


def ranked_results(picked: DataFrame, search: str, order: list[Column]) -> DataFrame:
    """search_id, rank from 0 and job_id of one search's picked rows (bounded by its count)."""
    return picked.select(F.lit(search).alias("search_id"), (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"), F.col("id").alias("job_id"))


def in_order(keys: DataFrame, rows: DataFrame, list_column: str, key: str) -> DataFrame:
    """`rows` in the order of a list of their keys, with pos; keys without a row are left out."""
    wanted = keys.select(*(c for c in keys.columns if c != list_column), F.posexplode(list_column).alias("pos", key))
    return wanted.join(rows, key)


def inserted_once(stored: DataFrame, arriving: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """`stored` and those of `arriving` whose keys it hasn't; of several that arrive with one key, the first. For trackers, labels and promotions.

    First is what has the least `order`, then (or without) what comes first as JSON. Rows with a null key are all new.
    """
    new = unseen(arriving, stored, keys)
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    turn = F.struct(*([order] if order is not None else []), F.to_json(F.struct(*arriving.columns)))
    once = new.where(known).groupBy(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys))).agg(F.min_by(F.struct(*arriving.columns), turn).alias("_row")).select("_row.*")
    return stored.unionByName(once.unionByName(new.where(~known)), allowMissingColumns=True)


def updated(rows: DataFrame, results: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`rows` with the columns of the results of their key, where there are any."""
    new = results.groupBy(key).agg(F.min(F.struct(*columns)).alias("_new"))
    return rows.join(new, key, "left").withColumns({c: F.coalesce(F.col(f"_new.{c}"), F.col(c)) for c in columns}).drop("_new")


def due(watches: DataFrame, now: str, most: int = 20) -> DataFrame:
    """Active watches whose time has come, the longest due first."""
    ready = watches.where(F.col("active") & (F.col("next_run_at") <= F.lit(now).cast("timestamp")))
    return ready.orderBy("next_run_at", "watch_id").limit(most)


def newest_within(rows: DataFrame, now: str, most: int, order: str, key: str) -> DataFrame:
    """What a store keeps: unexpired rows, of these the `most` newest."""
    return alive(rows, now).orderBy(F.desc(order), key).limit(most)


def newest_of_each(rows: DataFrame, owner: str, now: str, most: int, order: str, key: str) -> DataFrame:
    """What a store keeps for each owner: unexpired rows, of these the `most` newest. Tasks keep as many of an owner before they shuffle, so a hot owner is cut at once."""
    place = Window.partitionBy(owner).orderBy(F.desc(order), key)
    return alive(rows, now).withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= most).drop("_n")


def to_the_back(queue: DataFrame, skipped: DataFrame, key: str) -> DataFrame:
    """key and place from 0: the queue (key, place) with skipped rows behind all others, in their order."""
    marked = queue.join(skipped.select(key, F.lit(1).alias("_s")).distinct(), key, "left").withColumn("_s", F.coalesce("_s", F.lit(0)))
    n = marked.agg(F.max("place").alias("_n"))
    return marked.crossJoin(F.broadcast(n)).select(key, (F.col("place") + F.col("_s") * (F.col("_n") + 1)).alias("place"))


def owned(tables: dict[str, DataFrame], owner: str) -> DataFrame:
    """name, row: everything of one owner in every table, each row as JSON."""
    parts = [t.where(F.col("owner") == owner).select(F.lit(name).alias("name"), F.to_json(F.struct(*t.columns)).alias("row")) for name, t in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def metric_lines(counters: DataFrame, prefix: str = "app_") -> DataFrame:
    """name, line: counters (name, labels map, value) summed, as lines of the text exposition format."""
    from ..functions.phrases import label_value

    keys = F.array_sort(F.map_entries("labels"))
    told = F.array_join(F.transform(keys, lambda e: F.concat(e["key"], F.lit('="'), label_value(e["value"]), F.lit('"'))), ",")
    sums = counters.withColumn("told", told).groupBy("name", "told").agg(F.sum("value").alias("value"))
    number = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", F.col("value")), r"0+$", ""), r"\.$", "")
    name = F.concat(F.lit(prefix), F.col("name"))
    return sums.select("name", F.concat(name, F.when(F.col("told") != "", F.concat(F.lit("{"), F.col("told"), F.lit("}"))).otherwise(""), F.lit(" "), number).alias("line"))


def digests(matches: DataFrame, watch: str, most: int = 25, lines: int = 15) -> DataFrame:
    """watch, n, matches (the `most` best: id, title, score) and text (the `lines` best a line each), of scored new rows."""
    best = Window.partitionBy(watch).orderBy(F.desc("score"), "id")
    top = matches.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most)
    row = F.struct("_n", "id", "title", "score")
    listed = F.array_sort(F.collect_list(row))
    found = top.groupBy(watch).agg(listed.alias("rows")).join(matches.groupBy(watch).agg(F.count("*").alias("n")), watch)
    told = F.array_join(F.transform(F.slice("rows", 1, lines), lambda r: F.concat(F.lit("- "), r["title"], F.lit(" ("), r["score"].cast("string"), F.lit(")"))), "\n")
    return found.select(watch, "n", F.transform("rows", lambda r: F.struct(r["id"].alias("id"), r["title"].alias("title"), r["score"].alias("score"))).alias("matches"), told.alias("text"))


def canaries(found: DataFrame, sources: DataFrame) -> DataFrame:
    """source, jobs, ok: each source, and whether a probe gave it any posting."""
    n = found.groupBy("source").agg(F.count("*").alias("jobs"))
    return sources.join(n, "source", "left").select("source", F.coalesce("jobs", F.lit(0)).alias("jobs"), (F.coalesce("jobs", F.lit(0)) > 0).alias("ok"))


def boards(names: DataFrame, responses: DataFrame) -> DataFrame:
    """company, ats, slug, jobs: of the slugs that a company may have, each system's best recorded response (ats, slug, jobs); none below 0."""
    from ..functions.phrases import slug_candidates

    tried = names.select("company", F.posexplode(slug_candidates(F.col("company"))).alias("turn", "slug"))
    met = tried.join(responses.where("jobs >= 0"), "slug")
    best = met.groupBy("company", "ats").agg(F.max(F.struct("jobs", -F.col("turn"), "slug")).alias("b"))
    return best.select("company", "ats", "b.slug", "b.jobs")


POINTER = "CURRENT"  #: the file of a report's folder that names the version to read


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a function that makes paths under it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *parts]))


def _current(spark: SparkSession, path: str) -> str | None:
    files, under = _files(spark, path)
    if not files.exists(under(POINTER)):
        return None
    return "".join(r.value for r in spark.read.text(f"{path.rstrip('/')}/{POINTER}").collect())  # one line


def write_report(rows: DataFrame, path: str, kind: str = "csv", keep: int = 2) -> str:
    """A report in a new version folder under `path`, which readers see at once and whole, or not at all; gives the folder.

    CSV (every cell quoted, formulas made harmless) or JSON lines. The version is written beside the others; only then a
    pointer file is renamed over the old one, which the file system does in one step. If anything fails before, the old
    report stays. The `keep` newest versions stay in place for readers under way.
    """
    from ..functions.text import csv_safe

    spark, version = rows.sparkSession, f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    files, under = _files(spark, path)
    if kind == "csv":
        rows = rows.withColumns({c: csv_safe(F.col(c)) for c, t in rows.dtypes if t == "string"})
        rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(str(under(version)))
    else:
        rows.write.json(str(under(version)))
    point_to(spark, path, version)
    versions = sorted(s.getPath().getName() for s in files.listStatus(under()) if s.isDirectory() and s.getPath().getName().startswith("v"))
    for old in versions[: -max(1, keep)]:
        if old != version:
            files.delete(under(old), True)
    return str(under(version))


def point_to(spark: SparkSession, path: str, version: str) -> None:
    """The pointer file names another version, by one rename over the old file."""
    jvm = spark.sparkContext._jvm
    files, under = _files(spark, path)
    fresh = under(f".{POINTER}-{uuid.uuid4().hex}")
    out = files.create(fresh, False)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(files.makeQualified(fresh), files.makeQualified(under(POINTER)), options)


def read_report(spark: SparkSession, path: str, kind: str = "csv", schema: str | None = None) -> DataFrame | None:
    """The report that the pointer names; None if there is none yet."""
    version = _current(spark, path)
    if version is None:
        return None
    reader = spark.read.schema(schema) if schema else spark.read
    at = f"{path.rstrip('/')}/{version}"
    return reader.option("header", True).option("escape", '"').option("multiLine", True).csv(at) if kind == "csv" else reader.json(at)


def append_log(rows: DataFrame, path: str) -> None:
    """Append-only logs: feedback, calls, runs, digests."""
    rows.write.mode("append").parquet(path)
