"""Sharding by fixed virtual slots, in DataFrame operations only.

A row's virtual slot is a hash of its id; slots are many (4096) and fixed.
Bytes are summed per slot, and a versioned map says which shard holds a slot.
Balancing edits the map; rows never change their slot. Law: `bytes`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import clear_names, cut, fresh

VIRTUAL_SLOTS = 4096
#: Parts of a virtual slot whose rows are numbered in one sort.
CELLS = 16
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot")


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Adds size (UTF-8 bytes plus 1; a null text has none), text_crc32 and
    virtual_slot. Rows that share an id (or have none) are spread by their
    text's hash too, so that a hot id can't fill a slot."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = clear_names(docs, *(c for c in ADDED if c not in (id_col, text_col)))
    return base.withColumns({
        "size": F.octet_length(text).cast("long") + 1,
        "text_crc32": F.crc32(text.cast("binary")),
        "virtual_slot": F.pmod(F.xxhash64(F.col(id_col), text), F.lit(slots)).cast("int"),
    })


def slot_bytes(rows: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """virtual_slot, bytes, rows for every slot, empty ones too."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(F.broadcast(sums), "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def _folded(stats: DataFrame, start, step) -> DataFrame:
    """Folds the slots, largest first, into loads and a map: one bounded row."""
    packed = stats.agg(F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot", "shard")), asc=False).alias("all"))
    return packed.select(F.aggregate("all", start, step).alias("s")).select(F.explode("s.map").alias("m")).select("m.*")


def balanced_map(stats: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """A slot-to-shard map whose shards hold nearly equal bytes.

    The largest slot goes first, each to the lightest shard so far. The fold is
    one expression over one row of at most VIRTUAL_SLOTS entries.
    """
    start = F.expr(f"named_struct('load', array_repeat(0L, {shards}), 'map', cast(array() as array<struct<virtual_slot:int,shard:int>>))")

    def step(s, x):
        at = (F.array_position(s["load"], F.array_min(s["load"])) - 1).cast("int")
        load = F.transform(s["load"], lambda v, i: F.when(i == at, v + x["bytes"] + F.lit(0)).otherwise(v))
        entry = F.struct(x["virtual_slot"].alias("virtual_slot"), at.alias("shard"))
        return F.struct(load.alias("load"), F.concat(s["map"], F.array(entry)).alias("map"))

    out = _folded(stats.withColumn("shard", F.lit(0)), start, step)
    return out.select("virtual_slot", "shard", F.lit(version).alias("version"))


def grown_map(old: DataFrame, stats: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for one more shard (number `shards`).

    Slots move only into the new shard: largest first, from the heaviest shard
    that stays at or over the new mean, until the new one has its share.
    """
    both = stats.join(old.select("virtual_slot", "shard"), "virtual_slot")
    loads = both.groupBy("shard").agg(F.sum("bytes").alias("b"))
    first = F.expr(f"transform(sequence(0, {shards}), i -> coalesce(element_at(map_from_entries(l), cast(i as int)), 0L))")
    packed = both.agg(F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot", "shard")), asc=False).alias("all"))
    packed = packed.crossJoin(loads.agg(F.collect_list(F.struct(F.col("shard").cast("int"), "b")).alias("l"))).withColumn("load", first)
    mean = F.expr("aggregate(load, 0L, (a, x) -> a + x)") / F.lit(shards + 1)
    packed = packed.withColumn("mean", mean)

    def step(s, x):
        mine = F.element_at(s["load"], x["shard"] + 1)
        moves = (mine - x["bytes"] >= F.col("mean")) & (F.element_at(s["load"], shards + 1) + x["bytes"] <= F.col("mean"))
        to = F.when(moves, F.lit(shards)).otherwise(x["shard"])
        load = F.transform(s["load"], lambda v, i: F.when(moves & (i == x["shard"]), v - x["bytes"]).when(moves & (i == shards), v + x["bytes"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(s["map"], F.array(F.struct(x["virtual_slot"].alias("virtual_slot"), to.alias("shard")))).alias("map"))

    start = F.struct(F.col("load").alias("load"), F.expr("cast(array() as array<struct<virtual_slot:int,shard:int>>)").alias("map"))
    out = packed.select(F.aggregate("all", start, step).alias("s")).select(F.explode("s.map").alias("m")).select("m.*")
    version = old.agg(F.max("version").alias("v"))
    return out.crossJoin(F.broadcast(version)).select("virtual_slot", "shard", (F.col("v") + 1).alias("version"))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Adds this version to the stored maps; older versions stay."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest by default."""
    maps = spark.read.parquet(path)
    latest = maps.agg(F.max("version").alias("version")) if version is None else spark.createDataFrame([(version,)], "version int")
    return maps.join(F.broadcast(latest), "version", "left_semi").select("virtual_slot", "shard", "version")


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None, map_version: int | None = None) -> DataFrame:
    """Puts every row into a shard; adds size, text_crc32, law, shard, slot
    (the row's place in its shard, gapless from 0), grown_shard (null: the law
    is `bytes`) and virtual_slot.

    map_path: take the map stored there (its latest, or the given version); a
    path without maps gets version 1. Without it the map is made from these
    rows. Null ids and texts, repeated rows and empty tables are ordinary; an
    input column named like a new one is replaced. A shard's places follow
    (virtual slot, cell, id, crc); rows alike in all of these are told apart by
    an arbitrary order, which no other column shows. Equal texts are ordinary
    rows: the law is of bytes, so their ids may put them in different shards.
    """
    spark, (cell, n, base) = docs.sparkSession, (fresh(docs, c) for c in ("cell", "n", "base"))
    rows = with_slots(docs, id_col, text_col)
    # a cell is a fixed part of a slot: rows are numbered inside it
    rows = rows.withColumn(cell, F.pmod(F.xxhash64(F.lit(7), F.col(id_col), "text_crc32", "size"), F.lit(CELLS)).cast("int"))
    cells = cut(rows.groupBy("virtual_slot", cell).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    stats = slot_bytes_from(cells)
    if map_path is None:
        slot_map = balanced_map(stats, shards)
    else:
        try:
            slot_map = load_map(spark, map_path, map_version)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            save_map(balanced_map(stats, shards), map_path)
            slot_map = load_map(spark, map_path, map_version)
    slot_map = cut(slot_map.select("virtual_slot", "shard"))
    # at most VIRTUAL_SLOTS * CELLS rows: the base of every cell in its shard
    placed = cells.join(F.broadcast(slot_map), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", cell).rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.select("virtual_slot", cell, "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(base))
    within = Window.partitionBy("virtual_slot", cell).orderBy(F.col(id_col), "text_crc32", "size")
    keep = [c for c in rows.columns if c not in (cell,)]
    out = rows.withColumn(n, F.row_number().over(within) - 1).join(F.broadcast(cut(bases)), ["virtual_slot", cell])
    return out.select(
        *[c for c in keep if c != "virtual_slot"], F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col(base) + F.col(n)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def slot_bytes_from(cells: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """slot_bytes() from the sums of cells."""
    sums = cells.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    every = cells.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(F.broadcast(sums), "virtual_slot", "left").na.fill(0, ["bytes", "rows"])
