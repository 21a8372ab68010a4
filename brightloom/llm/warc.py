"""Merkle fixity audit of WARC replicas: trees over record digests and ordered offset ranges, compared from the root down.

A record's place in its archive's tree follows from its id, not from its position, and a node binds where its children
lie relative to its own start. So a lost, added or longer record changes the nodes above it and no others, and what
follows it isn't reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable
from .ordering import running

FANOUT = 16
LEVELS = 3  #: levels above the leaves; a tree has FANOUT ** LEVELS places for records
PER_ARCHIVE = FANOUT**LEVELS


def warc_record(record_id: Column, url: Column, payload: Column) -> Column:
    """The bytes of a WARC response record; null url or payload count as empty, a null id as `none`."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def archived(records: DataFrame, archive: Column, slot: Column, order: list[Column]) -> DataFrame:
    """`records` (with binary `record`) digested and laid out: archive, slot, key, seq, offset, length, digest, about.

    archive and slot (from 0 to PER_ARCHIVE - 1, ascending in `order`) must follow from the record's id alone, so that
    replicas agree on them. A null archive is one more archive, a null slot is 0. Records lie by archive, slot and `order`,
    whose values as text are the key that tells records of a slot apart; seq and offset count from 0 in each archive; a null record is an empty one. All other columns, whatever their names,
    go to the struct `about`; the bytes go. Repeated records and repeated ids share a slot. No records give no rows.
    """
    about = F.struct(*(F.col(f"`{c}`") for c in records.columns if c != "record")).alias("about")
    length = F.coalesce(F.octet_length("record"), F.lit(0)).cast("long")
    digest = F.sha2(F.coalesce("record", F.lit("").cast("binary")), 256)
    keys = [k.alias(f"k{n}") for n, k in enumerate(order)]
    told = records.select(archive.alias("archive"), F.coalesce(slot, F.lit(0)).cast("long").alias("slot"), length.alias("length"), digest.alias("digest"), about, F.to_json(F.struct(*keys)).alias("key"), F.struct(*keys).alias("keys"))
    placed, _, _ = running(told, [F.col("archive"), F.col("slot"), F.col("keys"), F.col("digest")], "length")
    starts = placed.groupBy("archive").agg(F.min("row_before").alias("first"), F.min("size_before").alias("start"))
    laid = placed.alias("p").join(starts.alias("s"), F.col("p.archive").eqNullSafe(F.col("s.archive")))
    return laid.select("p.archive", "slot", "key", (F.col("row_before") - F.col("first")).alias("seq"), (F.col("size_before") - F.col("start")).alias("offset"), "length", "digest", "about")


def leaves(manifest: DataFrame) -> DataFrame:
    """Level 0: a node for each slot, whose hash binds the number, lengths and digests of its records.

    Digests are added up in four parts of 15 digits, so that a slot of very many records is aggregated like any other.
    """
    sums = [F.sum(F.conv(F.substring("digest", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    bound = F.concat_ws(":", F.count("*"), F.sum("length"), *sums)
    return manifest.groupBy("replica", "archive", F.col("slot").alias("node")).agg(F.sha2(bound, 256).alias("hash"), F.min("offset").alias("lo"), F.max(F.col("offset") + F.col("length")).alias("hi"))


def above(nodes: DataFrame, fanout: int) -> DataFrame:
    """The next level: at most `fanout` ordered children a node, bound with the ranges where they lie from the node's start on."""
    children = F.array_sort(F.collect_list(F.struct("node", "lo", "hi", "hash")))
    grouped = nodes.groupBy("replica", "archive", F.expr(f"node div {fanout}").alias("up")).agg(children.alias("kids"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    told = F.array_join(F.transform("kids", lambda k: F.concat_ws(":", k["node"], k["lo"] - F.col("lo"), k["hi"] - F.col("lo"), k["hash"])), ",")
    return grouped.select("replica", "archive", F.col("up").alias("node"), F.sha2(told, 256).alias("hash"), "lo", "hi")


def differing(nodes: DataFrame) -> DataFrame:
    """archive, node and extent of each node whose hash differs between the replicas, or that only one of them has."""
    mine, theirs = (F.max(F.when(F.col("replica") == side, F.col("hash"))) for side in (False, True))
    return nodes.groupBy("archive", "node").agg(mine.alias("a"), theirs.alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(~F.col("a").eqNullSafe(F.col("b"))).drop("a", "b")


def below(nodes: DataFrame, suspects: DataFrame, fanout: int) -> DataFrame:
    """The children of suspect nodes."""
    up = suspects.select(F.col("archive").alias("its_archive"), F.col("node").alias("up"))
    return nodes.join(up, F.col("archive").eqNullSafe(F.col("its_archive")) & (F.expr(f"node div {fanout}") == F.col("up")), "left_semi")


def fixity_report(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """A row for each record that differs between two manifests of `archived`.

    archive, slot, seq, offset, length, replica_seq, replica_offset, replica_length, copies, status, about. status:
    `changed` (other bytes), `missing` (not in the replica), `extra` (only there), or `displaced` for a range of the tree
    whose records are all right but lie elsewhere from its start on (its seq, copies and about are null). about is the
    primary's, of an extra record the replica's. Where several records share slot and key, one that differs on each side is
    a `changed` one; more are told as `missing` and `extra`, equal ones in one row with their number of copies.
    Equal or empty manifests give no rows. Null archives and slots are keys like others; records whose bytes are null have
    the digest and length of none.
    """
    both = primary.withColumn("replica", F.lit(False)).unionByName(replica.withColumn("replica", F.lit(True)))
    tree = [leaves(both), durable(above(leaves(both), fanout))]  # higher levels are a small part of this one and are made from it
    while len(tree) <= levels:
        tree.append(above(tree[-1], fanout))
    suspects, displaced = differing(tree[-1]), []
    for level in range(levels - 1, -1, -1):
        suspects = durable(suspects)
        lower = durable(differing(below(tree[level], suspects, fanout)))
        owners = lower.select(F.col("archive").alias("its_archive"), F.expr(f"node div {fanout}").alias("up")).distinct()
        displaced.append(suspects.join(owners, F.col("archive").eqNullSafe(F.col("its_archive")) & (F.col("node") == F.col("up")), "left_anti").withColumn("slot", F.col("node") * fanout ** (level + 1)))
        suspects = lower
    slots = suspects.select(F.col("archive").alias("its_archive"), F.col("node").alias("its_slot"))
    place = F.struct("seq", "offset", "length", "about")
    sides = [F.col("replica"), ~F.col("replica")]
    told = both.join(slots, F.col("archive").eqNullSafe(F.col("its_archive")) & (F.col("slot") == F.col("its_slot")), "left_semi")
    told = told.groupBy("archive", "slot", "key", "digest").agg(F.count_if(sides[1]).alias("n_a"), F.count_if(sides[0]).alias("n_b"), F.min(F.when(sides[1], place)).alias("a"), F.min(F.when(sides[0], place)).alias("b"))
    told = durable(told.where("n_a <> n_b"))
    lost, new = F.col("n_a") > F.col("n_b"), F.col("n_b") > F.col("n_a")
    more = F.abs(F.col("n_a") - F.col("n_b"))
    pairs = told.groupBy("archive", "slot", "key").agg(F.sum(F.when(lost, more)).alias("lost"), F.sum(F.when(new, more)).alias("new"), F.min(F.when(lost, F.col("a"))).alias("a"), F.min(F.when(new, F.col("b"))).alias("b"))
    one = (F.col("lost") == 1) & (F.col("new") == 1)
    changed = pairs.where(one).select("archive", "slot", "a", "b", F.lit(1).cast("long").alias("copies"), F.lit("changed").alias("status"))
    rest = pairs.where(~F.coalesce(one, F.lit(False))).select(F.col("archive").alias("its_archive"), F.col("slot").alias("its_slot"), F.col("key").alias("its_key"))
    rest = told.join(rest, F.col("archive").eqNullSafe(F.col("its_archive")) & (F.col("slot") == F.col("its_slot")) & (F.col("key") == F.col("its_key")), "left_semi")
    rest = rest.select("archive", "slot", F.when(lost, F.col("a")).alias("a"), F.when(new, F.col("b")).alias("b"), more.alias("copies"), F.when(lost, "missing").otherwise("extra").alias("status"))
    columns = ["archive", "slot", "seq", "offset", "length", "replica_seq", "replica_offset", "replica_length", "copies", "status", "about"]
    found = changed.unionByName(rest)
    found = found.select(
        "archive", "slot", "a.seq", "a.offset", "a.length", F.col("b.seq").alias("replica_seq"), F.col("b.offset").alias("replica_offset"), F.col("b.length").alias("replica_length"),
        "copies", "status", F.coalesce("a.about", "b.about").alias("about"),
    )
    for nodes in displaced:
        found = found.unionByName(nodes.select("archive", "slot", F.col("lo").alias("offset"), (F.col("hi") - F.col("lo")).alias("length"), F.lit("displaced").alias("status")), allowMissingColumns=True)
    return found.select(*columns)
