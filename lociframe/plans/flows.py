"""Flows composed of the operators: from reads, a pair map and targets to realign
groups; from reads to haplotypes and the reads that stay; from two variant sets
and a truth to metrics. Aligning and calling are inputs, not features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import graphs, intervals, paralogs, phasing, reads, variants


def multialigned(r: DataFrame, targets: DataFrame, least: int = 5, share: float = 0.5, high: int = 10) -> DataFrame:
    """Regions of targets where enough reads align to other places too: one
    sweep gives all depths."""
    close = F.col("tag_as") - F.col("tag_xs") <= 5
    runs = intervals.depth_runs(r, high=F.col("mapq") >= 41, multi=F.col("xa") == 1, near=close)
    kept = runs.where((F.col("depth") >= least) & ((F.col("multi") >= share * F.col("depth")) | (F.col("near") >= share * F.col("depth"))) & (F.col("high") <= high))
    return intervals.intersect(intervals.merge(kept.select("chrom", "start", "end")), intervals.merge(targets.select("chrom", "start", "end")))


# --- regions ---------------------------------------------------------------------------


def pairs_on(pairs: DataFrame, regions: DataFrame, least_size: int) -> DataFrame:
    """Pairs of more than least_size whose side 1 overlaps a region, with the
    overlap and the region's text as target; both strands - become +; distinct,
    without nulls, and without umbrellas, of the pairs as they are and of the
    parts of side 2 that the region lifts to."""
    wide = pairs.where(F.col("end_1") - F.col("start_1") > least_size).withColumnsRenamed({"chr_1": "chrom", "start_1": "start", "end_1": "end"})
    hit = intervals.overlaps(wide, regions.select("chrom", "start", "end")).withColumnsRenamed({"chrom": "chr_1", "start": "start_1", "end": "end_1"})
    minus = (F.col("strand1") == "-") & (F.col("strand2") == "-")
    hit = hit.withColumns({"target": sc.region_text(F.col("chr_1"), F.col("start_b"), F.col("end_b")), "strand1": F.when(minus, "+").otherwise(F.col("strand1")), "strand2": F.when(minus, "+").otherwise(F.col("strand2"))})
    cols = ["target", "chr_1", "start_1", "end_1", "chr_2", "start_2", "end_2", "strand1", "strand2", "rate", "overlap_len"]
    own = hit.select(*cols, F.col("start_b").alias("target_start"), F.col("end_b").alias("target_end")).dropDuplicates(cols[:-2]).na.drop()
    own = graphs.checkpointed(own.withColumn("id", F.xxhash64(*cols[:-2])))
    lifted = intervals.lift(own).select("id", "target", "chr_1", F.greatest("start_1", "target_start").alias("start_1"), F.least("end_1", "target_end").alias("end_1"), "chr_2", F.col("lift_start").alias("start_2"), F.col("lift_end").alias("end_2"), "strand1", "strand2", "overlap_len")
    kept = graphs.without_umbrellas(own.select("id", *[c for c in cols if c != "rate"]), lifted, "target")
    return own.join(kept.select("id"), "id", "left_semi").select(*cols)


def prepare(r: DataFrame, pairs: DataFrame, targets: DataFrame, least_size: int = 300, least_window: int = 147, scale: float = 1.0) -> dict[str, DataFrame]:
    """regions, edges, groups (label, member, id) and tagged (the regions of the
    groups); scale: of a pair's rate to the weight of its edge."""
    regions = graphs.checkpointed(multialigned(r, targets))
    own = graphs.checkpointed(pairs_on(pairs, regions, least_size))
    side = lambda i: own.select(F.concat_ws(":", f"chr_{i}", f"start_{i}", f"end_{i}", f"strand{i}").alias("id"), F.col(f"chr_{i}").alias("chrom"), F.col(f"start_{i}").alias("start"), F.col(f"end_{i}").alias("end"), F.col(f"strand{i}").alias("strand"))
    nodes = side(1).unionByName(side(2)).distinct()
    touching = graphs.overlap_edges(nodes)
    both = graphs.compose(graphs.homology_edges(own).withColumn("weight", F.col("weight") * scale), touching)
    both = both.join(touching.select("a", "b", F.col("overlap").alias("bases")), ["a", "b"], "left").withColumn("bases", F.coalesce("bases", F.lit(0)))
    edges = graphs.checkpointed(graphs.prune(both, nodes, least_window, least_window))
    parts = graphs.checkpointed(graphs.components(edges))
    placed = graphs.checkpointed(nodes.join(parts, "id"))
    # an overlap edge tells by its type; a homology that overlaps is a homology
    weighted = edges.select("a", "b", "weight", (F.col("type") == "overlap").alias("overlap")).join(parts.select(F.col("id").alias("a"), "component"), "a")
    asked = side(1).select("id").distinct().join(parts, "id").select(F.col("id").alias("source"), "component")
    found = graphs.checkpointed(paralogs.counterparts(weighted, placed, asked, least=least_window))
    near = touching.select("a", "b").join(asked.select(F.col("source").alias("a")), "a", "left_semi").join(asked.select(F.col("source").alias("b")), "b", "left_semi")
    clash = paralogs.conflicts(found, asked.select(F.col("source").alias("id")), near).join(parts.select(F.col("id").alias("a"), "component"), "a")
    coloured = graphs.colours(graphs.checkpointed(clash), asked.select(F.col("source").alias("id"), "component"))
    groups = graphs.checkpointed(paralogs.realign_groups(found, coloured, placed))
    return {"regions": regions, "edges": edges, "groups": groups, "tagged": paralogs.group_regions(groups, found, placed)}


def group_statistics(tagged: DataFrame) -> DataFrame:
    """label, place (from 0, by covered bases, largest first), covered and
    subgroup (0 .. number of distinct query regions - 1), a row a subgroup."""
    label = F.regexp_extract("tag", r":(.+)_\d+$", 1)
    own = tagged.withColumn("label", label)
    covered = intervals.merge(own.select(F.col("label").alias("label"), "chrom", "start", "end"), 0, ("label", "chrom")).groupBy("label").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    n = own.where(F.col("tag").startswith("FC:")).distinct().groupBy("label").agg(F.count("*").alias("n"))
    # a row a group
    ranked = covered.join(n, "label").withColumn("place", F.row_number().over(Window.orderBy(F.col("covered").desc(), "label")) - 1)
    return ranked.select("label", "place", "covered", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("subgroup"))


def recall_beds(tagged: DataFrame, regions: DataFrame) -> DataFrame:
    """label, chrom, start, end: the queries of each group within the regions,
    merged."""
    queries, _ = paralogs.group_beds(tagged)
    return intervals.merge(intervals.intersect(queries.select("chrom", "start", "end", "label"), regions.select("chrom", "start", "end")), 0, ("label", "chrom"))


def sliced(r: DataFrame, targets: DataFrame, genome: DataFrame, delta: int = 1000, least: int = 2000, most: int = 10_000, depth: int = 3) -> DataFrame:
    """Reads by chunk: targets split by coverage; a chunk (its text) gets every
    read of the pairs that overlap it, mates elsewhere included."""
    blocks = intervals.depth_blocks(intervals.depth_runs(r), depth)
    split = intervals.target_split(targets, blocks, genome, delta, least, most).distinct()
    chunks = split.withColumn("chunk", sc.region_text(F.col("chrom"), F.col("start") + 1, F.col("end")))
    names = intervals.overlaps(r.select("chrom", "start", "end", "qname"), chunks).select(F.col("chunk_b").alias("chunk"), "qname").distinct()
    return r.join(names, "qname")


# --- haplotypes ----------------------------------------------------------------------------


def window_records(told: DataFrame, haps: DataFrame, length: float, width: int = 120, step: int = 30, least_depth: int = 5) -> DataFrame:
    """chunk, chrom, start, end, hap_id and per haplotype and window hap_depth,
    var_count and indel_count of its consensus, similarity, extreme, scatter.
    told: described reads (with qname); haps: qname, chunk, hap_id."""
    own = told.join(haps, "qname")
    depth = intervals.depth_runs(told.select("chrom", "start", (F.col("start") + F.size("vec")).alias("end")))
    windows = intervals.windows(intervals.depth_blocks(depth, least_depth, one_based=False), width, step).distinct()
    errs = sc.error_vector(sc.cigar_ops(F.col("cigar")), F.col("quals"))
    cells = own.select("hap_id", "chrom", F.col("id").alias("read"), "start", F.posexplode(F.arrays_zip(F.col("vec").alias("value"), errs.alias("err"))).alias("i", "x"))
    cells = cells.select(F.struct("hap_id", "chrom").alias("group"), (F.col("start") + F.col("i")).alias("pos"), F.col("x.value").alias("value"), F.col("x.err").alias("err"), "read")
    said = reads.consensus(cells).select(F.col("group.hap_id").alias("hap_id"), F.col("group.chrom").alias("chrom"), F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "value")
    per = intervals.overlaps(windows, said).select("chrom", "start", "end", F.col("hap_id_b").alias("hap_id"), F.col("start_b").alias("pos"), "value_b")
    vector = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value_b"))), lambda x: x["value_b"])
    facts = per.groupBy("chrom", "start", "end", "hap_id").agg(vector.alias("v"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    facts = facts.withColumns({"var_count": sc.count_snv(F.col("v")) + sc.count_indel(F.col("v")), "indel_count": sc.count_indel(F.col("v")), "span": F.col("high") - F.col("low") + 1})
    n = intervals.overlaps(windows, own.select("chrom", "start", (F.col("start") + F.size("vec")).alias("end"), "hap_id")).groupBy("chrom", "start", "end", F.col("hap_id_b").alias("hap_id")).agg(F.count("*").alias("n_reads"))
    deep = reads.haplotype_depths(facts.join(n, ["chrom", "start", "end", "hap_id"]), length).drop("total_depth")
    whole = own.groupBy("chunk", "hap_id").agg(F.bool_or(sc.extreme_density(F.col("vec"))).alias("extreme"), (F.count_distinct("qname") < 3).alias("scatter"))
    return deep.join(whole, "hap_id").withColumn("similarity", F.lit(0.0))


def inspect(records: DataFrame, members: DataFrame) -> DataFrame:
    """qname, chunk, mismapped: ranks, filter, program, decision.

    records: chunk, chrom, start, end, hap_id, hap_depth, var_count,
    indel_count, similarity, extreme, scatter; members: chunk, hap_id, qname.
    A chunk of at most two haplotypes is right as it is. Where the program ran
    for a chunk, all its scattered names are mismapped; else only those of
    scattered haplotypes with several variants.
    """
    told = graphs.checkpointed(records)
    ranked = reads.haplotype_ranks(told)
    kept = graphs.checkpointed(reads.haplotype_ranks(reads.haplotype_filter(ranked, 5, 8)))
    gain = kept.select(F.col("chunk").alias("component"), F.concat_ws(":", "chrom", "start", "end").alias("window"), "hap_id", "rank", (F.col("coefficient") + F.col("similarity")).alias("gain"))
    drops = graphs.checkpointed(graphs.select_drops(gain).select(F.col("component").alias("chunk"), "hap_id", "dropped"))
    ran = drops.select("chunk", F.lit(True).alias("ran")).distinct()
    haps = told.groupBy("chunk", "hap_id").agg(F.max("var_count").alias("var_count"), F.max("similarity").alias("similarity"), F.bool_or("extreme").alias("extreme"), F.bool_or("scatter").alias("scatter"))
    whole = members.select("chunk", "hap_id").distinct().join(haps, ["chunk", "hap_id"], "left").na.fill(0, ["var_count", "similarity"]).na.fill(False, ["extreme", "scatter"])
    judged = reads.decide(whole.join(drops, ["chunk", "hap_id"], "left").withColumn("dropped", F.coalesce("dropped", F.lit(False))))
    judged = reads.small_gate(judged, ["chunk"]).join(ran, "chunk", "left")
    bad = ~F.col("small") & (F.col("mismapped") | (F.coalesce("ran", F.lit(False)) & F.col("scatter")))
    return members.join(judged.select("chunk", "hap_id", bad.alias("mismapped")), ["chunk", "hap_id"]).select("qname", "chunk", "hap_id", "mismapped")


def phased(told: DataFrame, length: float) -> DataFrame:
    """qname, chunk, hap_id: pairs phased by how surely they come from one
    haplotype. A chunk is an island of overlapping reads, so that no overlap
    crosses its border; pairs that meet in several belong to the first."""
    spans = told.select("chrom", "start", (F.col("start") + F.size("vec")).alias("end"), "qname")
    chunk = intervals.islands(spans).groupBy("qname").agg(F.min(F.concat_ws(":", "chrom", F.col("island").cast("string"))).alias("chunk"))
    chunk = graphs.checkpointed(chunk)
    edges = phasing.phase_edges(phasing.compared_pairs(told, length), length)
    a, b = (chunk.select(F.col("qname").alias(s), F.col("chunk").alias(c)) for s, c in (("a", "chunk"), ("b", "other")))
    inside = edges.join(a, "a").join(b, "b").where("chunk = other").drop("other")
    found = graphs.haplotypes(graphs.checkpointed(inside), chunk.select("chunk", F.col("qname").alias("id")))
    return found.select(F.col("id").alias("qname"), "chunk", F.concat_ws(":", "chunk", F.col("hap").cast("string")).alias("hap_id"))


def eliminate(told: DataFrame, all_reads: DataFrame, length: float) -> DataFrame:
    """all_reads with tag and kept: described reads are phased, their haplotypes
    inspected, and reads of mismapped ones are not kept."""
    haps = graphs.checkpointed(phased(graphs.checkpointed(told), length))
    names = inspect(window_records(told, haps, length), haps)
    status = names.groupBy("qname").agg(F.min("hap_id").alias("hap"), F.when(F.bool_or("mismapped"), "mismapped").otherwise("correct").alias("status"))
    return reads.classified(all_reads, status, "0")


# --- variants -------------------------------------------------------------------------------


def benchmark(truth: DataFrame, calls: DataFrame, regions: DataFrame) -> DataFrame:
    """Metrics of calls against a truth within the regions: both restricted;
    truth alleles that the data can't show (see lost_alt) left out; of a site's
    calls one is picked; sites are compared. calls: caller, gt (a number)."""
    name = lambda gt: F.when(gt >= 2, "1/1").otherwise("0/1")
    own = variants.lost_alt(variants.in_regions(truth, regions))
    # of a site's alleles the least one tells the genotype
    own = own.groupBy("chrom", "pos").agg(F.min_by("gt", F.concat("ref", "alt")).alias("gt"))
    picked = variants.pick_called(variants.in_regions(calls, regions).where("gt > 0"))
    return variants.precision_recall(own.withColumn("gt", name(F.col("gt"))), picked.withColumn("gt", name(F.col("gt"))), ["chrom", "pos"])


def recall(r: DataFrame, pairs: DataFrame, targets: DataFrame, describe, called: DataFrame, recalled: DataFrame, length: float, **sizes) -> dict[str, DataFrame]:
    """The whole flow: groups, the reads recruited for them, which of these stay,
    and the two call sets merged. describe: reads -> described reads; called and
    recalled: call sets of the reads as they are and after elimination."""
    made = prepare(r, pairs, targets, **sizes)
    tagged = graphs.checkpointed(made["tagged"])
    own = reads.recruit(r, tagged.where(F.col("tag").startswith("FC:")))
    other = reads.recruit(r, tagged.where(F.col("tag").startswith("NFC:")), multialigned=True)
    recruited = graphs.checkpointed(own.unionByName(other).distinct())
    return made | {"tagged": tagged, "reads": eliminate(describe(recruited), recruited, length), "variants": variants.merge_priority(called, recalled)}
