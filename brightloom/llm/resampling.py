"""Target-distribution importance resampling over hashed word n-grams.

Each task hands its batches of texts to an in-process DuckDB: SQL unnests the words, windows make the n-grams, a registered
function gives zlib's CRC, and a row's bucket counts come back. Spark writes the counts as Parquet in the shared folder,
merges them into the corpus' and the target's counts, scores every row and draws the highest scores.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable
from .ordering import running

BUCKETS = 10_000
LONGEST = 1  #: words of the longest n-grams
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
BYTES = 4 << 20  #: of text that DuckDB gets at once; a longer text goes alone
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_duck: duckdb.DuckDBPyConnection | None = None  # of a worker; outlives a task


def crc32_of(grams: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(g) for g in grams.cast(pa.binary()).to_pylist()], pa.int64())


def connection() -> duckdb.DuckDBPyConnection:
    """DuckDB with one thread, as the task has one core, and a bound on its memory beyond which it spills beside the task."""
    global _duck
    if _duck is None:
        _duck = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": os.path.join(tempfile.gettempdir(), f"duckdb-{os.getpid()}")})
        _duck.create_function("crc32_of", crc32_of, [duckdb.sqltype("VARCHAR")], duckdb.sqltype("BIGINT"), type="arrow")
    return _duck


def counting_sql(longest: int, buckets: int) -> str:
    """Over `texts` (place, text): place, n_words, n_features, buckets and how often each; rows without words don't appear."""
    grams = ["select place, word as gram from words"]
    for n in range(2, longest + 1):
        run = " || ' ' || ".join(["word", *(f"lead(word, {k}) over following" for k in range(1, n))])
        grams.append(f"select place, gram from (select place, {run} as gram from words window following as (partition by place order by seq)) where gram is not null")
    return f"""
        with found as (select place, regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{WORD}') as list from texts),
        words as (select place, unnest(list) as word{", generate_subscripts(list, 1) as seq" if longest > 1 else ""} from found),
        grams as ({" union all ".join(grams)}),
        counted as (select place, gram, count(*) as n from grams group by place, gram),
        hashed as (select gram, crc32_of(gram) % {buckets} as bucket from (select distinct gram from counted)),
        merged as (select place, bucket, sum(n) as n from counted join hashed using (gram) group by place, bucket)
        select place, any_value(len(list))::bigint as n_words, sum(n)::bigint as n_features, list(bucket::int) as buckets, list(n::bigint) as times
        from merged join found using (place) group by place"""


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most BYTES of text, or one row."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column("text")).fill_null(0).to_pylist()
        begin, held = 0, 0
        for k, size in enumerate(sizes):
            if k > begin and held + size > BYTES:
                yield batch.slice(begin, k - begin)
                begin, held = k, 0
            held += size
        yield batch.slice(begin)


def counts(docs: DataFrame, key: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """key, n_words, n_features, buckets, times: a row for each row of `docs`, by DuckDB in each task, not yet written."""
    sql = counting_sql(longest, buckets)
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection()
        for batch in portions(batches):
            if not batch.num_rows:
                continue
            con.register("texts", pa.table({"place": pa.array(range(batch.num_rows), pa.int64()), "text": batch.column("text")}))
            columns: list[list] = [[0] * batch.num_rows, [0] * batch.num_rows, [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]]
            found = con.sql(sql).to_arrow_table()
            con.unregister("texts")
            order = pa.compute.sort_indices(found.column("place"))
            found = found.take(order)
            if found.num_rows == batch.num_rows:  # every row has words, so the places are all there
                told = [found.column(c).combine_chunks().cast(k) for c, k in zip(("n_words", "n_features", "buckets", "times"), kinds, strict=True)]
            else:
                for at, *cells in zip(*(found.column(c).to_pylist() for c in ("place", "n_words", "n_features", "buckets", "times")), strict=True):
                    for column, cell in zip(columns, cells, strict=True):
                        column[at] = cell
                told = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *told], ["key", "n_words", "n_features", "buckets", "times"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(count, f"key {docs.schema[key].dataType.simpleString()}, n_words long, n_features long, buckets array<int>, times array<long>")


def totals(counted: DataFrame, name: str) -> DataFrame:
    """bucket and its features over all rows; one row a bucket at most."""
    pairs = counted.select(F.explode(F.arrays_zip("buckets", "times")).alias("p"))
    return pairs.groupBy(F.col("p.buckets").alias("bucket")).agg(F.sum("p.times").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket and gain for every bucket: by how much the target favours it, in thousandths, floored."""
    every = corpus.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(F.broadcast(totals(corpus, "s")), "bucket", "left").join(F.broadcast(totals(target, "t")), "bucket", "left").na.fill(0, ["s", "t"])
    sums = [x.agg(F.coalesce(F.sum("n_features"), F.lit(0)).alias("n")).first().n for x in (corpus, target)]
    ahead = (F.col("t").cast("double") + 1) * F.lit(float(sums[0] + buckets))
    behind = (F.col("s").cast("double") + 1) * F.lit(float(sums[1] + buckets))
    return both.select("bucket", F.floor(F.ln(ahead / behind) * 1000).alias("gain"))


def luck(key: Column, seed: int) -> Column:
    """A Gumbel draw in thousandths that the seed and the id decide; a null id draws like an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """key, n_features, weight, score, rank: a row for each row of `docs`; rank is null for rows that aren't drawn.

    Of the rows with at least `least_words` words the `percent` % (floored) with the highest scores are drawn; ties go to
    the smaller id (null first), then to any. Null, empty and wordless texts have no features, weight 0 and are never drawn;
    repeated rows are rows of their own with equal scores. An empty target leaves the corpus' own counts in the gains; an
    empty table gives an empty result. Extra columns don't matter. The gains, a row a bucket, are broadcast.
    """
    counted = durable(counts(docs, key, longest, buckets).withColumn("row", F.monotonically_increasing_id()))
    wanted = durable(counts(target.select(F.lit(0).alias("id"), "text"), "id", longest, buckets))
    of_bucket = durable(gains(counted, wanted, buckets))
    pairs = counted.select("row", "key", "n_words", "n_features", F.explode_outer(F.arrays_zip("buckets", "times")).alias("p"))
    valued = pairs.select("row", "key", "n_words", "n_features", F.col("p.buckets").alias("bucket"), F.col("p.times").alias("times")).join(F.broadcast(of_bucket), "bucket", "left")
    weighed = valued.groupBy("row").agg(F.any_value("key").alias("key"), F.any_value("n_words").alias("n_words"), F.any_value("n_features").alias("n_features"), F.coalesce(F.sum(F.col("gain") * F.col("times")), F.lit(0)).alias("weight"))
    scored = durable(weighed.withColumn("score", F.col("weight") + luck(F.col("key"), seed)).drop("row"))
    able = F.col("n_words") >= least_words
    ranked, rows, _ = running(scored.where(able).withColumn("one", F.lit(1).cast("long")), [F.col("score").desc(), F.col("key").asc()], "one")
    drawn = percent * rows // 100
    rank = F.when(F.col("row_before") < drawn, F.col("row_before") + 1)
    told = ranked.select("key", "n_features", "weight", "score", rank.alias("rank"))
    rest = scored.where(~able).select("key", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return told.unionByName(rest).withColumnRenamed("key", key)
