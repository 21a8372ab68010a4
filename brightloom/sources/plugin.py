"""Feeds as a Spark data source: a plugin names its feeds' slugs and fetches one; Spark gives each slug, or each of its parts, a task.

`postings_source` makes a data source of a plugin. Filters on feed and slug are pushed down to the list of slugs (with the
option `pushdown` and spark.sql.python.filterPushdown.enabled; the option `feeds` does the same without). A slug that can't be fetched is a row with its
error, not an exception. `recorded` is the plugin of responses that something else has landed in a shared folder.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .feeds import FEEDS, read_feed, unreadable

SCHEMA = "feed string, slug string, payload string, error string"
MOST_LETTERS = 4 << 20  #: of payloads that go to Spark in one batch; a larger payload goes alone
PART_BYTES = 32 << 20  #: recorded files of a slug that make one task together
FILE_PAYLOADS = 500  #: in one recorded file


@dataclass(frozen=True)
class Plugin:
    """slugs(options): pairs of feed and slug. fetch(options, feed, slug): the payloads of one slug; it may raise.

    A plugin whose slugs can be large also has parts(options, feed, slug), names that make up the slug, and
    fetch_part(options, name), the payloads of one; each part is then a task.
    """

    name: str
    slugs: Callable[[dict], list[tuple[str, str]]]
    fetch: Callable[[dict, str, str], Iterator[str]]
    parts: Callable[[dict, str, str], list[str]] | None = None
    fetch_part: Callable[[dict, str], Iterator[str]] | None = None


@dataclass
class Slug(InputPartition):
    feed: str
    slug: str
    part: str | None = None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["feed", "slug", "payload", "error"])


class SlugReader(DataSourceReader):
    def __init__(self, plugin: Plugin, options: dict) -> None:
        self.plugin, self.options = plugin, options
        self.feeds = {f for f in options.get("feeds", "").split(",") if f} or None
        self.named: set[str] | None = None

    def partitions(self):
        pairs = self.plugin.slugs(self.options)
        wanted = [(f, s) for f, s in pairs if (self.feeds is None or f in self.feeds) and (self.named is None or s in self.named)]
        return [Slug(f, s, p) for f, s in wanted for p in (self.plugin.parts(self.options, f, s) if self.plugin.parts else [None])]

    def read(self, partition):
        if partition is None:  # there are no slugs
            return
        held, size = [], 0  # batches are bounded by letters, as Spark's own are by rows, whatever their length
        try:
            plugin, part = self.plugin, partition.part
            for payload in plugin.fetch(self.options, partition.feed, partition.slug) if part is None else plugin.fetch_part(self.options, part):
                if held and size + len(payload) > MOST_LETTERS:
                    yield _batch(held)
                    held, size = [], 0
                held.append((partition.feed, partition.slug, payload, None))
                size += len(payload)
        except Exception as e:  # a feed that fails is told, and the others go on
            held.append((partition.feed, partition.slug, None, f"{type(e).__name__}: {e}"))
        if held:
            yield _batch(held)


class PushingReader(SlugReader):
    """Spark calls this one's filters only where spark.sql.python.filterPushdown.enabled is set, and refuses it elsewhere."""

    def pushFilters(self, filters):  # noqa: N802 (Spark's name)
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("feed",):
                self.feeds = wanted if self.feeds is None else self.feeds & wanted
            elif wanted is not None and f.attribute == ("slug",):
                self.named = wanted if self.named is None else self.named & wanted
            else:
                yield f


def postings_source(plugin: Plugin) -> type[DataSource]:
    """A data source class to be registered with spark.dataSource.register."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return plugin.name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> SlugReader:
            pushing = str(self.options.get("pushdown", "")).lower() == "true"
            return (PushingReader if pushing else SlugReader)(plugin, dict(self.options))

    return Source


# --- recorded responses: <path>/feed=<feed>/slug=<slug>/ holds text files, a payload a line ---------------------------------


def _files(options: dict):
    from pyarrow import fs

    path = options["path"]
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _recorded_slugs(options: dict) -> list[tuple[str, str]]:
    from pyarrow import fs

    store, root = _files(options)
    found = set()
    for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        parts = info.path.split("/")
        if info.type == fs.FileType.Directory and parts[-1].startswith("slug=") and parts[-2].startswith("feed="):
            found.add((unquote(parts[-2][5:]), unquote(parts[-1][5:])))
    return sorted(found)


def _recorded_files(options: dict, feed: str, slug: str) -> list[tuple[str, int]]:
    """Path and bytes of each file of a slug."""
    from pyarrow import fs

    store, root = _files(options)
    found = []
    for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
        parts = info.path.split("/")
        if info.type == fs.FileType.File and len(parts) > 2 and unquote(parts[-2]) == f"slug={slug}" and unquote(parts[-3]) == f"feed={feed}" and not parts[-1].startswith((".", "_")):
            found.append((info.path, info.size))
    return sorted(found)


def _recorded_parts(options: dict, feed: str, slug: str) -> list[str]:
    """The files of a slug in lists of some PART_BYTES, as JSON; a larger file is one by itself."""
    lists, size = [], 0
    for path, n in _recorded_files(options, feed, slug):
        if not lists or size + n > PART_BYTES:
            lists.append([])
            size = 0
        lists[-1].append(path)
        size += n
    return [json.dumps(x) for x in lists]


def _recorded_part(options: dict, part: str) -> Iterator[str]:
    store, _ = _files(options)
    for path in json.loads(part):
        with store.open_input_stream(path) as stream, io.TextIOWrapper(stream, encoding="utf-8", newline="\n") as lines:
            for line in lines:
                if line != "\n":
                    yield line.removesuffix("\n")


def _recorded_payloads(options: dict, feed: str, slug: str) -> Iterator[str]:
    for part in _recorded_parts(options, feed, slug):
        yield from _recorded_part(options, part)


RECORDED = Plugin("recorded_feeds", _recorded_slugs, _recorded_payloads, _recorded_parts, _recorded_part)


def record(payloads: DataFrame, path: str) -> None:
    """Responses (feed, slug, payload without line breaks) landed in a folder that every task can reach."""
    payloads.select("feed", "slug", F.regexp_replace("payload", r"[\r\n]+", " ").alias("payload")).write.option("maxRecordsPerFile", FILE_PAYLOADS).partitionBy("feed", "slug").text(path)


def scan(spark: SparkSession, path: str, feeds: list[str] | None = None, plugin: Plugin = RECORDED) -> DataFrame:
    """feed, slug, payload, error: a row for each payload, or failure, of the feeds (all without a list)."""
    spark.dataSource.register(postings_source(plugin))
    pushing = (spark.conf.get("spark.sql.python.filterPushdown.enabled", None) or "false").lower()
    reader = spark.read.format(plugin.name).option("path", path).option("pushdown", pushing)
    return (reader.option("feeds", ",".join(feeds)) if feeds is not None else reader).load()


def all_postings(spark: SparkSession, path: str, plugin: Plugin = RECORDED) -> DataFrame:
    """The postings of every feed as one bag, a branch a feed, each of which reads its own slugs alone; failures are left to `failures`."""
    out = None
    for feed in FEEDS:
        own = read_feed(scan(spark, path, [feed], plugin).where("payload is not null"), feed)
        out = own if out is None else out.unionByName(own)
    return out


def failures(spark: SparkSession, path: str, plugin: Plugin = RECORDED) -> DataFrame:
    """feed, slug, reason: slugs that couldn't be fetched, payloads that aren't what their feed's schema says, and feeds that nobody knows."""
    every = scan(spark, path, None, plugin)
    out = every.where("error is not null").select("feed", "slug", F.col("error").alias("reason"))
    out = out.unionByName(every.where(~F.col("feed").isin(*FEEDS)).where("error is null").select("feed", "slug", F.lit("unknown feed").alias("reason")))
    for feed in FEEDS:
        bad = unreadable(scan(spark, path, [feed], plugin).where("payload is not null"), feed)
        out = out.unionByName(bad.select(F.lit(feed).alias("feed"), "slug", F.concat(F.lit("unreadable payload of "), F.col("length").cast("string"), F.lit(" letters")).alias("reason")))
    return out
