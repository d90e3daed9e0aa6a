"""Shards of near equal bytes over fixed virtual slots, in DataFrame functions only.

A record's id is hashed into one of ``SLOTS`` slots, for good. Bytes are aggregated by slot, and a small table maps slots to shards: one row a slot, stored by version.
The first version deals slots out in turn. Rebalancing edits it: a shard keeps its largest slots up to its equal part of all bytes, the slots beyond that form a
pool, and the pool fills the gaps of all shards, the largest first. So only what is over moves, a shard that is added gets rows from all others, and records whose slot
does not move stay where they are. Slots that alone hold more than a sixteenth of a shard are split into ``PARTS`` parts by the checksum of the text.

What is broadcast is bounded by the number of slots: the map, at most ``16 * shards`` heavy slots, and an offset for each slot or part. Records are shuffled as ids, sizes
and checksums only, after equal ones are counted.

Defined cases: a null text has size 1 and the checksum of the empty text; a null id is hashed as the empty string; rows of equal id and text are in one shard and have a
place each; an empty table gives no rows; other columns are kept by :func:`place`, which adds ``virtual_slot`` and ``shard`` (input columns of these names are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserine.llm.tables import kept
from tesserine.session import scratch_path

SLOTS, PARTS = 8192, 64
#: A slot is heavy if it holds more than this part of a shard.
HEAVY = 16
#: Equal rows that are written out from one counted row.
COPIES = 1 << 16


def slot_of(id_col: str) -> Column:
    """The slot of an id: the first 32 bits of its MD5, modulo the slots."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % SLOTS


def size_of(text_col: str) -> Column:
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1


def checksum(text_col: str) -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, checksum and slot of every row, written once."""
    return kept(docs.select(docs[id_col].alias("id"), size_of(text_col).alias("size"), checksum(text_col).alias("checksum"), slot_of(id_col).alias("slot")), "records")


def slot_bytes(rows: DataFrame, shards: int) -> DataFrame:
    """(slot, part, n_rows, bytes) of :func:`records`. ``part`` is null but for slots too heavy for one shard."""
    per_slot = kept(rows.groupBy("slot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("bytes")), "slots")
    all_bytes = F.sum("bytes").over(W.partitionBy())  # over at most SLOTS rows
    flagged = per_slot.withColumn("heavy", F.col("bytes") * (HEAVY * shards) > all_bytes)
    heavy = F.broadcast(flagged.where("heavy").select("slot"))  # at most HEAVY * shards rows
    parts = rows.join(heavy, "slot").groupBy("slot", (F.col("checksum") % PARTS).alias("part")).agg(F.count("*").alias("n_rows"), F.sum("size").alias("bytes"))
    return kept(flagged.where("NOT heavy").select("slot", F.lit(None).cast("long").alias("part"), "n_rows", "bytes").unionAll(parts.select("slot", "part", "n_rows", "bytes")), "units")


def first_map(spark: SparkSession, shards: int) -> DataFrame:
    """(slot, shards): the slots dealt out in turn. ``shards`` holds one shard, or one for each part of a heavy slot."""
    return spark.range(SLOTS).select(F.col("id").alias("slot"), F.array((F.col("id") % shards).cast("int")).alias("shards"))


def in_map(part: Column) -> Column:
    """The shard of a part: a slot with one shard has its parts there."""
    return F.expr("shards")[F.coalesce(part, F.lit(0)) % F.size("shards")]


def rebalanced(slot_map: DataFrame, units: DataFrame, shards: int) -> DataFrame:
    """The map edited for ``shards`` shards of near equal bytes. Shards from that number on are emptied; slots without rows move only out of those."""
    placed = units.join(F.broadcast(slot_map), "slot").withColumn("old", in_map(F.col("part")))
    placed = placed.select("slot", "part", "bytes", F.when(F.col("old") < shards, F.col("old")).alias("old"), F.sum("bytes").over(W.partitionBy()).alias("total"))
    heaviest = W.partitionBy("old").orderBy(F.desc("bytes"), "slot", "part")
    placed = placed.withColumn("stays", F.col("old").isNotNull() & (F.sum("bytes").over(heaviest) * shards <= F.col("total")))
    # gaps and pool as intervals on one line, in bytes * shards; a pooled slot goes to the gap that holds its middle
    numbers = units.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    held = placed.where("stays").groupBy(F.col("old").alias("shard")).agg(F.sum("bytes").alias("kept"))
    whole = units.agg(F.sum("bytes").alias("total")).select("total", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    gaps = numbers.join(held, "shard", "left").join(whole, "shard").select("shard", (F.col("total") - F.coalesce("kept", F.lit(0)) * shards).alias("gap"))
    gaps = gaps.select("shard", (2 * (F.sum("gap").over(W.orderBy(F.desc("gap"), "shard")) - F.col("gap"))).alias("at"), F.col("gap"))
    pool = placed.where("NOT stays").select("slot", "part", ((2 * F.sum("bytes").over(W.orderBy(F.desc("bytes"), "slot", "part")) - F.col("bytes")) * shards).alias("at"))
    line = gaps.where("gap > 0").select("shard", F.lit(None).cast("long").alias("slot"), F.lit(None).cast("long").alias("part"), "at").unionAll(pool.select(F.lit(None).cast("int"), "slot", "part", "at"))
    dealt = line.withColumn("new", F.last("shard", ignorenulls=True).over(W.orderBy("at", F.expr("slot IS NOT NULL"), "slot", "part"))).where("slot IS NOT NULL")
    moved = placed.where("stays").select("slot", "part", F.col("old").alias("new")).unionAll(dealt.select("slot", "part", "new"))
    new = moved.groupBy("slot").agg(F.max(F.when(F.col("part").isNull(), F.col("new"))).alias("whole"), F.map_from_entries(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("part", "new")))).alias("parts"))
    old = slot_map.select("slot", F.transform("shards", lambda s: F.when(s < shards, s).otherwise(s % shards)).alias("shards"))
    every_part = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")), lambda p: F.coalesce(F.expr("parts")[p], F.expr("shards")[p % F.size("shards")]))
    return old.join(new, "slot", "left").select("slot", F.when(F.col("whole").isNotNull(), F.array("whole")).when(F.size("parts") > 0, every_part).otherwise(F.col("shards")).alias("shards"))


def store(slot_map: DataFrame, path: str, version: int) -> DataFrame:
    """Write a version of the map. Earlier versions stay; one that is there already is an error."""
    slot_map.coalesce(1).write.parquet(f"{path}/version={version}")
    return load(slot_map.sparkSession, path, version)


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the latest unless one is named."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version).select("slot", "shards")


def balanced_map(units: DataFrame, shards: int, path: str) -> DataFrame:
    """The map of a new collection: version 0 in turn, version 1 edited by bytes."""
    return store(rebalanced(store(first_map(units.sparkSession, shards), path, 0), units, shards), path, 1)


def place(docs: DataFrame, slot_map: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with ``virtual_slot`` and ``shard``; nothing is shuffled. Write them by ``shard`` to have the shards."""
    looked = docs.withColumn("virtual_slot", slot_of(id_col)).join(F.broadcast(slot_map.select(F.col("slot").alias("_slot"), F.col("shards").alias("_shards"))), F.col("virtual_slot") == F.col("_slot"))
    return looked.withColumn("shard", F.col("_shards")[(checksum(text_col) % F.size("_shards")).cast("int")]).drop("_slot", "_shards")


def shard_rows(docs: DataFrame, shards: int = 8, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, size, checksum, virtual slot and shard, and its place ``slot`` in the shard, from 0 without gaps.

    Places go by virtual slot, part of it, id, checksum and size. The versions of the map are stored at ``path``, or in a new folder of the shared one.
    """
    rows = records(docs, id_col, text_col)
    units = slot_bytes(rows, shards)
    slot_map = balanced_map(units, shards, path or scratch_path(docs.sparkSession, "slot-map"))
    found = units.join(F.broadcast(slot_map), "slot").withColumn("shard", in_map(F.col("part")))
    before = W.partitionBy("shard").orderBy("slot", "part")
    found = found.select("slot", "shard", F.coalesce("part", F.lit(-1)).alias("part"), (F.sum("n_rows").over(before) - F.col("n_rows")).alias("first"))
    starts = F.broadcast(found.groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct("part", F.struct("shard", "first")))).alias("starts")))
    alike = rows.groupBy("slot", "id", "checksum", "size").agg(F.count("*").alias("n")).join(starts, "slot")
    alike = alike.withColumn("part", F.when(F.expr("starts[-1] IS NULL"), F.col("checksum") % PARTS).otherwise(F.lit(-1).cast("long")))
    alike = alike.withColumn("start", F.expr("starts[part]")).drop("starts")
    in_unit = W.partitionBy("slot", "part").orderBy("id", "checksum", "size")
    alike = alike.withColumn("first", F.col("start.first") + F.sum("n").over(in_unit) - F.col("n"))
    some = alike.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    each = some.withColumn("k", F.explode(F.sequence("from", F.least(F.col("from") + COPIES, F.col("n")) - 1)))
    return each.select(F.col("id").alias(id_col), "size", F.col("checksum").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("start.shard").alias("shard"), (F.col("first") + F.col("k")).alias("slot"),
                       F.lit(None).cast("int").alias("grown_shard"), F.col("slot").alias("virtual_slot"))
