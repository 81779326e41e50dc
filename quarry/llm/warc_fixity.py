"""Merkle fixity audit of WARC replicas, in DataFrame operations alone.

Records are filed in shards of SHARD_SLOTS consecutive ids. A leaf is the digest of a slot's records; a node covers
FANOUT consecutive children, that is an ordered range of slots and of byte offsets, and its digest is that of its
children's digests in order; a shard's root covers it all. Two replicas are compared root by root, and only children
of nodes that differ are compared further, down to the slots that are damaged.

Record bytes are hashed once where they are read; only ids, lengths and digests are kept, as tables in the shared folder,
one for each level. A slot can hold any number of records that share an id (null ids all do): its digest is that of the
count and sums of its records' digests, lane by lane, which pre-aggregate. No list holds more than FANOUT digests, and
offsets are told within a slot by length and head of digest, so that a hot slot is many groups.

Defined results: null urls and payloads are empty; a null id counts as -1. Records that share an id share a slot and
its verdict, whatever their order. A slot is ok, corrupt (digests differ), missing (not in the replica) or extra (only there).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import stored

#: A power of two.
SHARD_SLOTS = 4096
FANOUT = 16
#: Digests are added up in lanes of so many hex digits, which sums of longs hold for any number of records.
LANE = 8


def record_text(id_: Column, url: Column, payload: Column) -> Column:
    """A WARC/1.0 record as text: header, empty line, payload, two line ends."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), id_.cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One row per record: id, shard, slot, length (bytes), digest."""
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(-1))
    made = pages.select(id_.alias("id"), record_text(id_, F.col(url_col), F.col(payload_col)).alias("record"))
    shard = F.shiftright("id", SHARD_SLOTS.bit_length() - 1)  # a division would round ids beyond 2^53
    return made.select("id", shard.alias("shard"), F.pmod("id", F.lit(SHARD_SLOTS)).alias("slot"), F.octet_length("record").cast("long").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("digest"))


def _digest_in_order(key: str) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(key, "digest")))
    return F.sha2(F.concat_ws("", F.transform(pairs, lambda p: p["digest"])).cast("binary"), 256)


def tree(recs: DataFrame) -> list[DataFrame]:
    """Levels from the slots (0) to the shards' roots: (shard, node, digest, n_bytes)."""
    lanes = [F.sum(F.conv(F.substring("digest", at, LANE), 16, 10).cast("long")).cast("string") for at in range(1, 65, LANE)]
    leaves = recs.groupBy("shard", F.col("slot").alias("node")).agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *lanes).cast("binary"), 256).alias("digest"), F.sum("length").alias("n_bytes"))
    levels = [stored(leaves, "level")]
    span = SHARD_SLOTS
    while span > 1:
        below = levels[-1]
        above = below.groupBy("shard", F.floor(F.col("node") / FANOUT).cast("long").alias("up")).agg(_digest_in_order("node").alias("digest"), F.sum("n_bytes").alias("n_bytes"))
        levels.append(stored(above.withColumnRenamed("up", "node"), "level"))
        span = -(-span // FANOUT)
    return levels


def differing_slots(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """(shard, node, status) of the slots that differ, found by descending from differing roots."""
    suspects: DataFrame | None = None
    for one, other in zip(reversed(a), reversed(b)):
        left, right = one.select("shard", "node", F.col("digest").alias("here")), other.select("shard", "node", F.col("digest").alias("there"))
        if suspects is not None:
            parent = suspects.select("shard", F.col("node").alias("parent"))
            left, right = (x.join(parent, (x["shard"] == parent["shard"]) & (F.floor(x["node"] / FANOUT) == parent["parent"]), "left_semi") for x in (left, right))
        both = left.join(right, ["shard", "node"], "full_outer")
        status = F.when(F.col("there").isNull(), "missing").when(F.col("here").isNull(), "extra").otherwise("corrupt")
        suspects = stored(both.where(~F.col("here").eqNullSafe(F.col("there"))).select("shard", "node", status.alias("status")), "suspects")
    return suspects


def with_offsets(recs: DataFrame) -> DataFrame:
    """Records with their byte offset in the shard, in order of slot, length and digest; from the sizes of slots, then of
    records of one length and head of digest, then of the records themselves."""
    recs = recs.withColumn("head", F.substring("digest", 1, 3))
    before = lambda key, *order: F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = recs.groupBy("shard", "slot", "length", "head").agg(F.sum("length").alias("n"), F.count("*").alias("records"))
    slots = groups.groupBy("shard", "slot").agg(F.sum("n").alias("n")).select("shard", "slot", before(["shard"], "slot").alias("of_slot"))
    within = groups.select("shard", "slot", "length", "head", "records", before(["shard", "slot"], "length", "head").alias("of_group"))
    starts = within.join(slots, ["shard", "slot"]).select("shard", "slot", "length", "head", "records", (F.col("of_slot") + F.col("of_group")).alias("start"))
    each = recs.join(starts, ["shard", "slot", "length", "head"])
    # a group of one record, as nearly all are, needs no order
    one = each.where("records = 1").withColumn("offset", F.col("start"))
    more = each.where("records > 1").withColumn("n", F.col("length"))
    more = more.withColumn("offset", F.col("start") + before(["shard", "slot", "length", "head"], "digest")).drop("n")
    return one.unionByName(more).drop("head", "records", "start")


def audit(recs: DataFrame, replica: DataFrame) -> DataFrame:
    """One row per record of either side that is in a shard of the first, and for extra slots: id, shard, slot, offset, length, digest, status."""
    recs, replica = stored(recs, "records"), stored(replica, "records")
    found = differing_slots(tree(recs), tree(replica)).withColumnRenamed("node", "slot")
    placed = with_offsets(recs)
    mine = placed.join(found, ["shard", "slot"], "left").select("id", "shard", "slot", "offset", "length", "digest", F.coalesce("status", F.lit("ok")).alias("status"))
    extra = replica.join(found.where("status = 'extra'"), ["shard", "slot"]).select("id", "shard", "slot", F.lit(None).cast("long").alias("offset"), "length", "digest", "status")
    return mine.unionByName(extra)
