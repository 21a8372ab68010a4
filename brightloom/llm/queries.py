"""The queries of this package, each over its whole table with production parameters, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontamination import contamination_report
from .language_id import language_report
from .line_dedup import line_report
from .media import document_media
from .near_duplicates import classes
from .packing import pack_documents
from .resampling import resampled
from .sharding import shard_by_bytes
from .token_counts import token_report
from .toxicity import toxicity_report
from .url_filters import judge
from .warc import PER_ARCHIVE, archived, fixity_report, warc_record
from .whitening import whitening_report


def vocabulary() -> str:
    """The public byte-level vocabulary; elsewhere another path can be passed to the operators."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(table(spark, sf_dir, "documents"), vocabulary())


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The rules of the url filter query.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "rule string, action string"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, audited against a replica with planted damage.

    In the replica records of every 97th page have a changed first character, those of some other pages are longer, lost,
    or stand with one more record of the page's id, a revisit.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = F.when(F.col("page_id") % 97 == 0, F.overlay("html", F.lit("#"), 1, 1)).when(F.col("page_id") % 89 == 5, F.concat("html", F.lit("<!-- cut"))).otherwise(F.col("html"))
    damaged = pages.where("page_id is null or page_id % 83 <> 11").withColumn("html", text)
    damaged = damaged.unionByName(pages.where("page_id % 79 = 7").withColumns({"url": F.concat("url", F.lit("#revisit")), "html": F.lit("")}))
    number = F.col("page_id").cast("long")
    manifests = [
        archived(x.withColumn("record", warc_record(F.col("page_id"), F.col("url"), F.col("html"))).drop("html"), F.floor(number / PER_ARCHIVE), F.pmod(number, F.lit(PER_ARCHIVE)), [number, F.col("url")])
        for x in (pages, damaged)
    ]
    return fixity_report(*manifests).select("archive", "slot", "seq", "offset", "length", "replica_seq", "replica_offset", "replica_length", "copies", "status", "about.page_id", "about.url")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_report(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_decontamination, op3_url_filters, op4_toxicity, op5_media_columns, op6_ngram_jaccard_join, op7_best_fit_packing, op8_byte_shards, op9_token_counts, op10_warc_fixity, op11_embedding_whitening, op12_importance_resampling, op13_line_dedup)
}

ORACLE_SQL = {
    "op3_url_filters": r"""
        with split as (
            select page_id, case when contains(url, '://') then translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
                case when contains(url, '://') then regexp_extract(url, '://[^/?#]*([^?#]*)', 1) else '' end as path
            from pages),
        rules(rule, rule_host, rule_path, action) as (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
            ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
        best as (
            select host, path, arg_max(rule, length(rule)) as rule, arg_max(action, length(rule)) as action
            from (select distinct host, path from split) s join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
            group by host, path)
        select page_id, split.host, split.path, rule, coalesce(action, 'allow') as verdict
        from split left join best on split.host = best.host and split.path = best.path""",
    "op8_byte_shards": """
        with sized as (
            select doc_id, hex(encode(coalesce(text, ''))) as data, octet_length(encode(coalesce(text, ''))) + 8 as size from documents),
        steps as (
            select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as step
            from range(256) t(i)),
        summed as (
            select *, xor(4294967295, list_reduce(
                list_transform(regexp_extract_all(data, '..'), lambda b: cast('0x' || b as bigint)),
                lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295)) as text_crc32
            from sized, steps),
        placed as (
            select *, sum(size) over (order by doc_id rows unbounded preceding) - size as ahead, sum(size) over () as volume from summed),
        cut as (
            select *, cast(least(23, (24 * (2 * ahead + size)) // (2 * volume)) as int) as shard from placed)
        select doc_id, cast(size as bigint) as size, text_crc32, 'bytes' as law, shard,
            row_number() over (partition by shard order by doc_id) - 1 as slot, cast(null as int) as grown_shard
        from cut""",
    "op10_warc_fixity": """
        with replica as (
            select page_id, url, case when page_id % 97 = 0 then '#' || substring(html, 2) when page_id % 89 = 5 then html || '<!-- cut' else html end as html
            from pages where page_id % 83 <> 11
            union all select page_id, url || '#revisit', '' from pages where page_id % 79 = 7),
        sized as (
            select side, page_id, url, html, length('WARC/1.0..WARC-Type: response..WARC-Record-ID: <urn:page:>..WARC-Target-URI: ..Content-Length: ....') + length(cast(page_id as varchar))
                + octet_length(encode(url)) + length(cast(octet_length(encode(html)) as varchar)) + octet_length(encode(html)) + 4 as length
            from (select 'a' as side, page_id, url, html from pages union all select 'b', * from replica)),
        laid as (
            select *, row_number() over archive - 1 as seq, sum(length) over (archive rows unbounded preceding) - length as "offset"
            from sized window archive as (partition by side, page_id // 4096 order by page_id, url)),
        a as (select * from laid where side = 'a'), b as (select * from laid where side = 'b')
        select page_id // 4096 as archive, page_id % 4096 as slot, a.seq, cast(a."offset" as bigint) as "offset", cast(a.length as bigint) as length,
            b.seq as replica_seq, cast(b."offset" as bigint) as replica_offset, cast(b.length as bigint) as replica_length,
            cast(1 as bigint) as copies, case when b.url is null then 'missing' when a.url is null then 'extra' else 'changed' end as status, page_id, url
        from a full join b using (page_id, url) where a.html is distinct from b.html""",
    "op12_importance_resampling": r"""
        with words as (
            select 'documents' as side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from documents
            union all
            select 'benchmark', null, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) from benchmark),
        steps as (
            select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as step
            from range(256) t(i)),
        hashed as (
            select word, xor(4294967295, list_reduce(
                list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda b: cast('0x' || b as bigint))),
                lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]))) % 10000 as bucket
            from (select distinct word from words), steps),
        placed as (select side, doc_id, bucket from words join hashed using (word)),
        held as (
            select bucket, count(*) filter (side = 'documents') as s, count(*) filter (side = 'benchmark') as t from placed group by bucket),
        gained as (
            select bucket, cast(floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double))) as bigint) as gain from held),
        weighed as (
            select doc_id, count(*) as n_features, cast(sum(gain) as bigint) as weight from placed join gained using (bucket) where side = 'documents' group by doc_id),
        lucky as (
            select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
                cast(floor(-1000 * ln(-ln((cast('0x' || substring(sha256('2024:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as draw
            from documents left join weighed using (doc_id)),
        ranked as (
            select *, weight + draw as score, n_features >= 20 as able, row_number() over (partition by n_features >= 20 order by weight + draw desc, doc_id) as place,
                count(*) filter (n_features >= 20) over () as n from lucky)
        select doc_id, n_features, weight, score, case when able and place <= 10 * n // 100 then place end as rank from ranked""",
    "op13_line_dedup": r"""
        with lines as (
            select doc_id, seq, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from (select doc_id, unnest(list) as line, generate_subscripts(list, 1) as seq from (select doc_id, string_split(coalesce(text, ''), chr(10)) as list from documents))),
        repeated as (
            select key, max(doc_id) as keeper from lines where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
        marked as (
            select lines.*, keeper is not null and keeper <> doc_id as gone from lines left join repeated using (key))
        select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by seq) filter (not gone), '')) as kept_sha256
        from marked group by doc_id""",
}
