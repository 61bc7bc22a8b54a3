"""Interval algebra on half-open intervals (chrom, start, end), 0-based.

Sweeps run within tiles of a chrom and take up what earlier tiles leave (a
furthest end, a depth, a count) from a table of a row per tile; joins are
equi-joins on (chrom, bin). So neither needs a chrom in one task. Extra columns
pass through where a result row belongs to one input row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a bin of the range join: about the longest usual interval.
BIN = 64


#: Positions of a tile of a sweep.
TILE = 1 << 16


def _earlier(tiles: DataFrame, keys: list[str], **carried: Column) -> DataFrame:
    """keys, __tile and what the earlier tiles of the same keys leave; tiles has
    a row per tile. carried: names and aggregates over those rows."""
    before = Window.partitionBy(*keys).orderBy("__tile").rowsBetween(Window.unboundedPreceding, -1)
    return tiles.select(*keys, "__tile", *[c.over(before).alias(n) for n, c in carried.items()])


def _same_tile(keys: list[str], a: DataFrame, b: DataFrame) -> DataFrame:
    """a with b's columns of the same tile; null keys are equal."""
    names = [*keys, "__tile"]
    right = b.withColumnsRenamed({k: f"{k}__t" for k in names})
    on = [F.col(k).eqNullSafe(F.col(f"{k}__t")) for k in names]
    return a.join(right, on, "left").drop(*[f"{k}__t" for k in names])


def _with_reach(df: DataFrame, keys: list[str], order: list[Column], tile: int) -> tuple[DataFrame, object]:
    """df with __tile and __reach, the furthest end of all earlier rows of the
    same keys (by start, then order), and the window of a tile."""
    tiled = df.withColumn("__tile", F.floor(F.col("start") / tile))
    ends = tiled.groupBy(*keys, "__tile").agg(F.max("end").alias("m"))
    both = _same_tile(keys, tiled, _earlier(ends, keys, __before=F.max("m")))
    within = Window.partitionBy(*keys, "__tile").orderBy(*order)
    own = F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("__reach", F.greatest(own, F.col("__before"))).drop("__before"), within


def islands(df: DataFrame, gap: int = 0, keys: tuple[str, ...] = ("chrom",), out: str = "island", tile: int = TILE) -> DataFrame:
    """Adds an island number per keys: rows whose start is at most `gap` after
    the furthest end so far share one. Book-ended intervals (gap 0) touch. Equal
    intervals are peers, so that the number hangs on no order among them."""
    names = list(keys)
    reached, within = _with_reach(df, names, [F.col("start"), F.col("end")], tile)
    opens = F.when(F.col("__reach").isNull() | (F.col("start") > F.col("__reach") + gap), 1).otherwise(0)
    opened = reached.withColumn("__opens", opens).drop("__reach")
    counts = opened.groupBy(*names, "__tile").agg(F.sum("__opens").alias("n"))
    both = _same_tile(names, opened, _earlier(counts, names, __count=F.sum("n")))
    number = F.sum("__opens").over(within.rangeBetween(Window.unboundedPreceding, Window.currentRow)) + F.coalesce("__count", F.lit(0))
    return both.withColumn(out, number).drop("__opens", "__count", "__tile")


def merge(df: DataFrame, gap: int = 0, keys: tuple[str, ...] = ("chrom",), **aggregates: Column) -> DataFrame:
    """The union of intervals per keys; aggregates add columns of a group."""
    grouped = islands(df, gap, keys).groupBy(*keys, "island")
    return grouped.agg(F.min("start").alias("start"), F.max("end").alias("end"), *[c.alias(n) for n, c in aggregates.items()]).drop("island")


def merge_stranded(df: DataFrame, first: tuple[str, ...] = (), distinct: tuple[str, ...] = ()) -> DataFrame:
    """Merge per strand; columns of the first interval, or distinct values
    joined by commas in order."""
    order = F.struct("start", "end", *first)
    added = {c: F.min_by(c, order) for c in first} | {c: F.concat_ws(",", F.array_sort(F.collect_set(F.col(c).cast("string")))) for c in distinct}
    return merge(df, 0, ("chrom", "strand"), **added)


def binned(df: DataFrame, size: int = BIN, start: str = "start", end: str = "end") -> DataFrame:
    last = F.greatest(F.col(end) - 1, F.col(start))
    return df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(last / size))))


def overlaps(a: DataFrame, b: DataFrame, size: int = BIN, how: str = "inner") -> DataFrame:
    """All columns of a, those of b with suffix _b, and overlap_len, for each
    overlapping pair on a chrom. how: inner, or left (rows of a without a hit
    have nulls and overlap_len 0).

    Both sides are dealt by (chrom, bin); a pair that shares several bins is
    kept in the first bin of their overlap.
    """
    right = b.select(*[F.col(c).alias(f"{c}_b") for c in b.columns])
    x, y = binned(a, size), binned(right, size, "start_b", "end_b").withColumnRenamed("__bin", "__bin_b")
    on = (F.col("chrom") == F.col("chrom_b")) & (F.col("__bin") == F.col("__bin_b")) & (F.col("start") < F.col("end_b")) & (F.col("start_b") < F.col("end"))
    hit = x.join(y, on).where(F.col("__bin") == F.floor(F.greatest("start", "start_b") / size)).drop("__bin", "__bin_b")
    hit = hit.withColumn("overlap_len", F.least("end", "end_b") - F.greatest("start", "start_b"))
    if how == "inner":
        return hit
    # rows of a without any hit: their coordinates alone decide
    lone = a.join(hit.select("chrom", "start", "end").distinct(), ["chrom", "start", "end"], "left_anti").select(*a.columns)
    for c, kind in right.dtypes:
        lone = lone.withColumn(c, F.lit(None).cast(kind))
    return hit.unionByName(lone.withColumn("overlap_len", F.lit(0)))


def intersect(a: DataFrame, b: DataFrame, size: int = BIN) -> DataFrame:
    """The clipped piece of every hit, with a's other columns."""
    hit = overlaps(a, b, size)
    clip = {"start": F.greatest("start", "start_b"), "end": F.least("end", "end_b")}
    return hit.withColumns(clip).select(*a.columns)


def semi(a: DataFrame, b: DataFrame, size: int = BIN) -> DataFrame:
    """Rows of a that overlap any interval of b, once each. b is merged first,
    which bounds the hits of a row."""
    # coordinates alone decide, so rows need no numbers (which a second reading
    # of the same table might give out otherwise)
    place = ["chrom", "start", "end"]
    hit = overlaps(a.select(*place).distinct(), merge(b.select(*place)), size).select(*place).distinct()
    return a.join(hit, place, "left_semi").select(*a.columns)


def subtract(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("chrom", "strand")) -> DataFrame:
    """What merged b (per keys) leaves of each interval of a."""
    holes = merge(b, 0, keys)
    cut = [F.col("start"), F.col("end"), *[F.col(k) for k in keys if k != "chrom"]]
    names = ["start", "end", *[k for k in keys if k != "chrom"]]
    holes = holes.select("chrom", *[c.alias(n) for c, n in zip(cut, names, strict=True)])
    numbered = a.withColumn("__a", F.monotonically_increasing_id())
    hit = overlaps(numbered, holes, how="left")
    same = F.lit(True)
    for k in keys:
        if k != "chrom":
            same = same & (F.col(k) == F.col(f"{k}_b"))
    piece = F.when(same & F.col("start_b").isNotNull(), F.struct(F.greatest("start", "start_b").alias("s"), F.least("end", "end_b").alias("e")))
    group = hit.groupBy("__a", *a.columns).agg(F.sort_array(F.collect_set(piece)).alias("c"))
    rest = F.transform(F.sequence(F.lit(0), F.size("c")), lambda i: F.struct(
        F.when(i == 0, F.col("start")).otherwise(F.get(F.col("c"), F.greatest(i - 1, F.lit(0)))["e"]).alias("s"),
        F.when(i == F.size("c"), F.col("end")).otherwise(F.get(F.col("c"), i)["s"]).alias("e")))
    others = [c for c in a.columns if c not in ("start", "end")]
    return group.select(*others, F.explode(F.filter(rest, lambda x: x["s"] < x["e"])).alias("x")).select(*others, F.col("x.s").alias("start"), F.col("x.e").alias("end")).select(*a.columns)


def slop(df: DataFrame, genome: DataFrame, k: int) -> DataFrame:
    """Pads both ends by k within [0, length]; genome: chrom, length."""
    sizes = genome.select("chrom", "length")
    return df.join(sizes, "chrom").withColumns({"start": F.greatest(F.lit(0), F.col("start") - k), "end": F.least("length", F.col("end") + k)}).select(*df.columns)


def total_coverage(df: DataFrame) -> DataFrame:
    """Bases of the merged union: one row."""
    return merge(df.select("chrom", "start", "end")).agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias("covered"))


def depth_runs(df: DataFrame, tile: int = TILE, **measures: Column) -> DataFrame:
    """Runs (chrom, start, end) of constant depth > 0, by a sweep over starts
    and ends. measures: names and 0/1 columns, each a further depth."""
    names = ["depth", *measures]
    weighted = df.select("chrom", "start", "end", F.lit(1).alias("depth"), *[c.cast("int").alias(n) for n, c in measures.items()])
    up = weighted.select("chrom", F.col("start").alias("pos"), *names)
    down = weighted.select("chrom", F.col("end").alias("pos"), *[(-F.col(n)).alias(n) for n in names])
    steps = up.unionByName(down).groupBy("chrom", "pos").agg(*[F.sum(n).alias(n) for n in names])
    tiled = steps.withColumn("__tile", F.floor(F.col("pos") / tile))
    totals = tiled.groupBy("chrom", "__tile").agg(F.min("pos").alias("first"), *[F.sum(n).alias(n) for n in names])
    later = Window.partitionBy("chrom").orderBy("__tile")
    before = later.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("chrom", "__tile", F.lead("first").over(later).alias("__next"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in names])
    order = Window.partitionBy("chrom", "__tile").orderBy("pos")
    both = _same_tile(["chrom"], tiled, carried)
    depth = [(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"__{n}")).alias(n) for n in names]
    sums = both.select("chrom", F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(order), F.col("__next")).alias("end"), *depth)
    return sums.where(F.col("end").isNotNull() & (F.col("depth") > 0))


def per_base(runs: DataFrame) -> DataFrame:
    """One row per base of depth runs; pos is 1-based."""
    others = [c for c in runs.columns if c not in ("start", "end")]
    return runs.select(*others, F.explode(F.sequence(F.col("start") + 1, F.col("end"))).alias("pos"))


def depth_blocks(runs: DataFrame, minimum: int, one_based: bool = True) -> DataFrame:
    """Maximal stretches of depth >= minimum. one_based keeps the 1-based first
    position as the start (end is the last position + 1)."""
    blocks = merge(runs.where(F.col("depth") >= minimum).select("chrom", "start", "end"))
    shift = 1 if one_based else 0
    return blocks.withColumns({"start": F.col("start") + shift, "end": F.col("end") + shift})


def windows(df: DataFrame, width: int, step: int) -> DataFrame:
    """Tiles of each interval; the last ones are cut at its end."""
    others = [c for c in df.columns if c not in ("start", "end")]
    tiles = df.select(*others, "end", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(step))).alias("w"))
    return tiles.select(*others, F.col("w").alias("start"), F.least(F.col("w") + width, "end").alias("end"))


def drop_contained(df: DataFrame, tile: int = TILE) -> DataFrame:
    """Drops intervals that an earlier one (by start, longest first) encloses;
    of equal ones one stays."""
    reached, _ = _with_reach(df, ["chrom"], [F.col("start"), F.col("end").desc()], tile)
    return reached.where(F.col("__reach").isNull() | (F.col("end") > F.col("__reach"))).drop("__reach", "__tile")


def complement_new(new: DataFrame, inspected: DataFrame) -> DataFrame:
    """Parts of new intervals that the inspected ones don't cover."""
    return subtract(new, inspected, ("chrom",))


def lift(df: DataFrame) -> DataFrame:
    """Maps [target_start, target_end) on side 1 onto side 2 of a pair: by
    offset on the same strand, mirrored from the end on the other; clipped."""
    a, b = F.greatest("target_start", "start_1") - F.col("start_1"), F.least("target_end", "end_1") - F.col("start_1")
    same = F.col("strand1") == F.col("strand2")
    s = F.when(same, F.col("start_2") + a).otherwise(F.col("end_2") - b)
    e = F.when(same, F.col("start_2") + b).otherwise(F.col("end_2") - a)
    return df.withColumns({"lift_start": F.greatest(s, "start_2"), "lift_end": F.least(e, "end_2")}).where("lift_start < lift_end")


def lift_relative(query: DataFrame, counterparts: DataFrame, targets: DataFrame, pad: int) -> DataFrame:
    """Targets within query intervals of a group, padded and merged in relative
    coordinates, projected onto each counterpart of the group (mirrored on the
    other strand), clipped and merged. query, counterparts: group, chrom,
    start, end, strand; a query interval's place is its group's."""
    hit = overlaps(query, targets.select("chrom", "start", "end"))
    length = F.col("end") - F.col("start")
    rel = hit.select("group", "strand", length.alias("length"), F.greatest(F.lit(0), F.greatest("start", "start_b") - F.col("start") - pad).alias("start"), F.least(length, F.least("end", "end_b") - F.col("start") + pad).alias("end"))
    # pieces that meet also meet where they are projected to, and are merged there
    rel = rel.distinct().withColumnsRenamed({"start": "rs", "end": "re", "strand": "strand_q"})
    both = counterparts.join(rel, "group")
    same = F.col("strand") == F.col("strand_q")
    s = F.when(same, F.col("start") + F.col("rs")).otherwise(F.col("end") - F.col("re"))
    e = F.when(same, F.col("start") + F.col("re")).otherwise(F.col("end") - F.col("rs"))
    out = both.select("group", "chrom", F.greatest(s, "start").alias("s"), F.least(e, "end").alias("e")).where("s < e")
    return merge(out.select("group", "chrom", F.col("s").alias("start"), F.col("e").alias("end")), 0, ("group", "chrom"))


def lift_pairs(pairs: DataFrame, targets: DataFrame, pad: int) -> DataFrame:
    """lift_relative for pairs as groups of their own, side 1 the query and side
    2 the counterpart: the columns of each distinct pair and the lifted start
    and end. Targets are met by the distinct sides 1; pairs are dealt once."""
    place = ["chr_1", "start_1", "end_1"]
    length = F.col("end") - F.col("start")
    side = pairs.select(*[F.col(c).alias(n) for c, n in zip(place, ("chrom", "start", "end"), strict=True)]).distinct()
    low, high = F.greatest(F.lit(0), F.greatest("start", "start_b") - F.col("start") - pad), F.least(length, F.least("end", "end_b") - F.col("start") + pad)
    met = overlaps(side, targets.select("chrom", "start", "end")).select(F.col("chrom").alias("chr_1"), F.col("start").alias("start_1"), F.col("end").alias("end_1"), low.alias("__s"), high.alias("__e")).distinct()
    # merged within the side, where its pieces are already in one task
    within = Window.partitionBy(*place).orderBy("__s", "__e").rowsBetween(Window.unboundedPreceding, -1)
    opened = met.repartition(*place).withColumn("__reach", F.max("__e").over(within)).withColumn("__opens", F.when(F.col("__s") <= F.col("__reach"), 0).otherwise(1))
    merged = opened.withColumn("__k", F.sum("__opens").over(within.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*place, "__k").agg(F.min("__s").alias("__s"), F.max("__e").alias("__e"))
    # dealt by side 1, distinct pairs and the join need no further dealing
    both = pairs.repartition(*place).distinct().join(merged, place)
    same = F.col("strand1") == F.col("strand2")
    s = F.when(same, F.col("start_2") + F.col("__s")).otherwise(F.col("end_2") - F.col("__e"))
    e = F.when(same, F.col("start_2") + F.col("__e")).otherwise(F.col("end_2") - F.col("__s"))
    return both.select(*pairs.columns, F.greatest(s, "start_2").alias("start"), F.least(e, "end_2").alias("end")).where("start < end")


def target_split(targets: DataFrame, blocks: DataFrame, genome: DataFrame, delta: int, least: int, most: int) -> DataFrame:
    """Splits targets by coverage islands: merged with gap 2 delta; those over
    `most` become their covered pieces, those under `least` the islands they
    lie in (an island over `most`: the target padded by delta), the rest stay."""
    merged = merge(targets.select("chrom", "start", "end"), 2 * delta)
    length = F.col("end") - F.col("start")
    large = intersect(merged.where(length > most), blocks)
    hit = overlaps(merged.where(length < least), blocks.select("chrom", "start", "end"), how="left")
    island = F.col("end_b") - F.col("start_b")
    fits = F.col("start_b").isNotNull() & (island <= most)
    small = hit.withColumns({
        "s": F.when(fits, F.col("start_b")).when(F.col("start_b").isNotNull(), F.greatest(F.lit(0), F.col("start") - delta)).otherwise(F.col("start") - delta),
        "e": F.when(fits, F.col("end_b")).otherwise(F.col("end") + delta), "clip": F.col("start_b").isNotNull() & ~fits,
    }).join(genome.select("chrom", "length"), "chrom")
    small = small.select("chrom", F.col("s").alias("start"), F.when(F.col("clip"), F.least("e", "length")).otherwise(F.col("e")).alias("end"))
    return merged.where(length.between(least, most)).unionByName(large).unionByName(small)


def validate_bed(df: DataFrame) -> DataFrame:
    """Rows that are no intervals, and why."""
    why = F.when(F.col("chrom").isNull() | (F.col("chrom") == ""), "no chrom").when(F.col("start").isNull() | F.col("end").isNull(), "no coordinates").when(F.col("start") < 0, "negative start").when(F.col("end") <= F.col("start"), "empty")
    return df.withColumn("problem", why).where(F.col("problem").isNotNull())
