"""Aligned reads: filters, recruiting, statistics; haplotype records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import aligned_blocks, bound, cigar_ops, haplotype_tag, longest_gap, parse_region, poisson_quantile, query_index
from .intervals import overlaps, semi

UNMAPPED, SECONDARY, QCFAIL, DUPLICATE, SUPPLEMENTARY, PROPER, FIRST, SECOND = 4, 256, 512, 1024, 2048, 2, 64, 128


def has(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(bits) != 0


def tag_condition(tag: str, gap: int = 5) -> Column:
    """XS: AS - XS of at most `gap` where both are known, else whether XS is
    there; another tag: its 0/1 column."""
    if tag == "xs":
        return F.coalesce(F.col("tag_as") - F.col("tag_xs") <= gap, F.col("tag_xs").isNotNull())
    return F.col(tag) == 1


def read_filter(df: DataFrame, least_mapq: int, tags: tuple[str, ...] = (), logic: str = "and") -> DataFrame:
    """Mapped primary reads of enough quality that meet the tag logic: and, or,
    not (none of the tags)."""
    ok = (F.col("mapq") >= least_mapq) & ~has(F.col("flag"), UNMAPPED | SECONDARY | QCFAIL | DUPLICATE | SUPPLEMENTARY)
    if tags:
        conditions = [tag_condition(t) for t in tags]
        if logic == "and":
            ok = ok & reduce(lambda a, b: a & b, conditions)
        elif logic == "or":
            ok = ok & reduce(lambda a, b: a | b, conditions)
        elif logic == "not":
            ok = ok & ~reduce(lambda a, b: a | b, conditions)
        else:
            raise ValueError(f"logic is and, or or not, not {logic}")
    return df.where(ok)


def noisy(flag: Column, mapq: Column, span: Column, mate_elsewhere: Column, quals: Column | None = None, clipped: Column | None = None, least_mapq: int = 10, cut: int = 15) -> Column:
    """The ordered rules of a noisy read."""
    out = (
        F.when(has(flag, SECONDARY | SUPPLEMENTARY), False)
        .when(has(flag, UNMAPPED | QCFAIL) | (mapq < least_mapq) | span.isNull(), True)
        .when(has(flag, 1) & ((span < 75) | mate_elsewhere), True)
        .when(~has(flag, 1) & has(flag, DUPLICATE), True)
    )
    if quals is not None:
        ranked = F.sort_array(quals)
        half = F.floor(F.size(quals) / 2)
        median = (F.get(ranked, half.cast("int")) + F.get(ranked, F.floor((F.size(quals) - 1) / 2).cast("int"))) / 2.0
        out = out.when((median <= cut) | (F.size(F.filter(quals, lambda q: q < cut)) >= 50), True)
    if clipped is not None:
        out = out.when(clipped >= 20, True)
    return out.otherwise(False)


def clean_pairs(df: DataFrame, noisy_col: str = "noisy") -> DataFrame:
    """qname, chrom, start, end of pairs without a noisy read and with both
    mates, wherever they are; a span for each chrom."""
    flag = F.col("flag")
    per_chrom = df.groupBy("qname", "chrom").agg(F.bool_or(noisy_col).alias("bad"), F.bool_or(has(flag, FIRST)).alias("r1"), F.bool_or(has(flag, SECOND)).alias("r2"), F.min("start").alias("start"), F.max("end").alias("end"))
    pair = Window.partitionBy("qname")
    told = per_chrom.withColumns({c: F.bool_or(c).over(pair) for c in ("bad", "r1", "r2")})
    return told.where("not bad and r1 and r2").select("qname", "chrom", "start", "end")


def recruit(reads: DataFrame, regions: DataFrame, multialigned: bool = False) -> DataFrame:
    """All reads of pairs of which a mate overlaps the regions; multialigned:
    only mates with an alternative alignment or mapq under 50 count."""
    found = semi(reads.where((F.col("xa") == 1) | (F.col("mapq") < 50)) if multialigned else reads, regions)
    return reads.join(found.select("qname").distinct(), "qname", "left_semi")


def first_of_duplicates(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def first_of_unordered(pairs: DataFrame, value: str = "rate") -> DataFrame:
    """x, y, value of the first of the pairs (a, b) that have the same ends in
    whatever order, by (first end, second end, value)."""
    turned = pairs.select(F.least("a", "b").alias("__x"), F.greatest("a", "b").alias("__y"), F.struct((F.col("a") > F.col("b")).alias("t"), F.col(value).alias("v")).alias("__f"))
    first = turned.groupBy("__x", "__y").agg(F.min("__f").alias("__f"))
    ends = [F.when(F.col("__f.t"), F.col(p)).otherwise(F.col(q)) for p, q in (("__y", "__x"), ("__x", "__y"))]
    return first.select(ends[0].alias("x"), ends[1].alias("y"), F.col("__f.v").alias(value))


def sampled(df: DataFrame, per_mille: int, run: int = 0, key: str = "qname") -> DataFrame:
    """All rows of a share of the keys, the same at each run of that number."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(run))))
    return df.where(F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(1000)) < per_mille)


def first_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in a total order: the sample that a mean is taken of."""
    return df.orderBy(*order).limit(n)


def insert_statistics(sizes: DataFrame, column: str = "size") -> DataFrame:
    """Mean, median and population deviation of sizes up to the 99th percentile.
    The percentiles are of counts by size, so that one task gets a row for each
    size and not for each read."""
    counts = sizes.groupBy(F.col(column).alias("s")).agg(F.count("*").alias("n"))
    top = counts.agg(F.percentile("s", 0.99, F.col("n")).alias("top"))
    kept = counts.crossJoin(F.broadcast(top)).where(F.col("s") <= F.col("top"))
    n, total, squares = F.sum("n"), F.sum(F.col("s") * F.col("n")), F.sum(F.col("s").cast("double") * F.col("s") * F.col("n"))
    return kept.agg((total / n).alias("mean"), F.percentile("s", 0.5, F.col("n")).alias("median"), F.sqrt(F.greatest(squares / n - (total / n) * (total / n), F.lit(0.0))).alias("deviation"), n.alias("n"))


def averaged_insert_statistics(df: DataFrame, runs: int = 10, per_mille: int = 1, column: str = "size", key: str = "qname") -> DataFrame:
    """The mean of the statistics of several samples by name, one row."""
    every = [insert_statistics(sampled(df, per_mille, k, key).select(column), column) for k in range(runs)]
    return reduce(lambda a, b: a.unionByName(b), every).agg(*[F.avg(c).alias(c) for c in ("mean", "median", "deviation")])


def region_reads(df: DataFrame, regions: DataFrame, early: bool = True, once: bool = False) -> DataFrame:
    """Reads by region, as an indexed fetch gives them: a read is there once for
    each region that it overlaps. early: a region begins one base before its
    start (its text is read as 1-based); once: each read only once."""
    wide = regions.select("chrom", F.greatest(F.col("start") - int(early), F.lit(0)).alias("start"), "end")
    if once:
        return semi(df, wide)
    return overlaps(df, wide).select(*df.columns)


def aligned_depth_input(df: DataFrame, least_mapq: int = 0, least_quality: int = 0) -> DataFrame:
    """chrom, start, end of the aligned blocks (no deletions) of reads of enough
    mapq; with a least base quality, single bases that reach it. df: chrom,
    start, mapq, cigar and, for qualities, quals."""
    ops = cigar_ops(F.col("cigar"))
    kept = df.where(F.col("mapq") >= least_mapq)
    if not least_quality:
        return kept.select("chrom", F.explode(aligned_blocks(ops, F.col("start"))).alias("b")).select("chrom", F.col("b.s").alias("start"), F.col("b.e").alias("end"))
    # bases are chosen before they become rows, so that no row carries qualities
    told = F.struct(query_index(ops).alias("index"), F.col("quals").alias("quals"))
    places = bound(told, lambda t: F.filter(F.sequence(F.lit(0), F.size(t["index"]) - 1), lambda i: (F.size(t["index"]) > i) & (F.get(t["index"], i) >= 0) & (F.get(t["quals"], F.greatest(F.get(t["index"], i), F.lit(0))) >= least_quality)))
    good = kept.select("chrom", "start", F.explode(places).alias("at"))
    return good.select("chrom", (F.col("start") + F.col("at")).alias("start"), (F.col("start") + F.col("at") + 1).alias("end"))


def summary_numbers(lines: DataFrame) -> DataFrame:
    """name, value of the SN lines of a statistics report (column value)."""
    f = F.split("value", "\t")
    return lines.where(F.col("value").startswith("SN\t")).select(F.rtrim(F.regexp_replace(f[1], ":$", "")).alias("name"), f[2].cast("double").alias("number"))


def haplotype_ranks(records: DataFrame) -> DataFrame:
    """Adds rank (dense, by 50 variants + indels within a window), total_depth
    and coefficient = rank * span * sqrt(1 - depth / total)."""
    window = Window.partitionBy("chrom", "start", "end")
    ranked = records.withColumns({"rank": F.dense_rank().over(window.orderBy(F.col("var_count") * 50 + F.col("indel_count"))), "total_depth": F.sum("hap_depth").over(window)})
    share = F.try_divide(F.col("hap_depth").cast("double"), "total_depth")
    return ranked.withColumn("coefficient", F.col("rank") * (F.col("end") - F.col("start")) * F.sqrt(F.greatest(F.lit(1.0) - share, F.lit(0.0))))


def haplotype_filter(records: DataFrame, least_depth: int = 5, most_similar: float = 8, least_size: int = 3) -> DataFrame:
    """Records that count for the selection, in windows of least_size or more."""
    kept = records.where(f"not extreme and not scatter and total_depth >= {least_depth} and similarity <= {most_similar}")
    return kept.withColumn("__n", F.count("*").over(Window.partitionBy("chrom", "start", "end"))).where(F.col("__n") >= least_size).drop("__n")


def small_gate(haps: DataFrame, keys: list[str], most: int = 2) -> DataFrame:
    """Adds small: whether there are at most `most` haplotypes, so that all are
    taken to be right."""
    return haps.withColumn("small", F.count("*").over(Window.partitionBy(*keys)) <= most)


def best_scores(haps: DataFrame, scores: DataFrame) -> DataFrame:
    """Adds best: the highest score of each haplotype (hap, score), at least 0."""
    top = scores.groupBy("hap").agg(F.max("score").alias("__s"))
    return haps.join(top, "hap", "left").withColumn("best", F.greatest(F.coalesce("__s", F.lit(0.0)), F.lit(0.0))).drop("__s")


def decide(haps: DataFrame) -> DataFrame:
    """Adds mismapped: dropped by the program, extreme, too similar to another
    copy, or scattered with several variants."""
    bad = F.col("dropped") | F.col("extreme") | (F.col("similarity") > 5) | (F.col("scatter") & (F.col("var_count") > 1))
    return haps.withColumn("mismapped", F.coalesce(bad, F.lit(False)))


def consensus(values: DataFrame) -> DataFrame:
    """group, pos, value of the least error (under 0.1; of equal ones the later
    read's). values: group, pos, value, err, read."""
    return values.where("err < 0.1").groupBy("group", "pos").agg(F.max_by("value", F.struct(-F.col("err"), F.col("read"))).alias("value"))


def for_insert_sizes(df: DataFrame, longest: int = 8000) -> DataFrame:
    """Properly paired primary reads whose template length tells an insert."""
    bad = UNMAPPED | 8 | SECONDARY | SUPPLEMENTARY
    return df.where(has(F.col("flag"), PROPER) & ~has(F.col("flag"), bad) & (F.col("chrom") == F.col("mate_chrom")) & (F.abs("tlen") <= longest))


def for_mismatches(df: DataFrame) -> DataFrame:
    """Surely placed reads (mapq 60, proper, primary, no alternative place)."""
    bad = UNMAPPED | SECONDARY | SUPPLEMENTARY | DUPLICATE | QCFAIL
    return df.where(has(F.col("flag"), PROPER) & ~has(F.col("flag"), bad) & (F.col("xa") == 0) & (F.col("mapq") == 60))


def mismatch_limit(df: DataFrame, alpha: float = 0.05, least: int = 4) -> DataFrame:
    """rate, cutoff: the mean of nm without the longest gap, and the smallest
    count whose Poisson probability reaches 1 - alpha, at least `least`."""
    own = F.col("nm") - longest_gap(cigar_ops(F.col("cigar")))
    rate = df.agg(F.avg(F.greatest(own, F.lit(0))).alias("rate"))
    return rate.withColumn("cutoff", F.greatest(poisson_quantile(F.col("rate"), 1 - alpha), F.lit(least)))


def rebased(df: DataFrame, label: str) -> DataFrame:
    """Places on masked contigs named chrom:offset as places on the genome (of a
    mate too, if there is mate_pos); the label goes to the read name."""
    parts = F.split("contig", ":")
    places = {c: parts[1].cast("long") + F.col(c) for c in ("pos", "mate_pos") if c in df.columns}
    return df.withColumns({"chrom": parts[0], **places, "qname": F.concat(F.col("qname").cast("string"), F.lit(f":{label}"))}).drop("contig")


def first_alignments(df: DataFrame) -> DataFrame:
    """Of each origin (chrom:start-end in `origin`) the first alignment in scan
    order, unless it is unmapped, supplementary or back at its own origin.
    df: origin, scan, chrom, start, flag."""
    first = first_of_duplicates(df, ["origin"], [F.col("scan")])
    place = parse_region(F.col("origin"))
    home = (F.col("chrom") == place["chrom"]) & (F.col("start") + 1 == place["start"])
    return first.where(~has(F.col("flag"), UNMAPPED | SUPPLEMENTARY) & ~F.coalesce(home, F.lit(False)))


def window_haplotypes(windows: DataFrame, spans: DataFrame, share: float = 0.8, enough: int = 2) -> DataFrame:
    """chrom, start, end, hap, span_start, span_end: the haplotype spans that
    enclose each window. A window of at most `enough` such spans shrinks to the
    common part of the spans that cover at least `share` of it, and is given up
    if still no more than `enough` are left. spans: chrom, start, end, hap."""
    hit = overlaps(windows.select("chrom", "start", "end").distinct(), spans.select("chrom", "start", "end", "hap"))
    encloses = (F.col("start_b") <= F.col("start")) & (F.col("end_b") >= F.col("end"))
    wide = hit.withColumns({"encloses": encloses, "wide": ~encloses & (F.col("overlap_len") >= share * (F.col("end") - F.col("start")))})
    one = Window.partitionBy("chrom", "start", "end")
    told = wide.where("encloses or wide").withColumns({
        "whole": F.sum(F.col("encloses").cast("int")).over(one), "n": F.count("*").over(one),
        "low": F.greatest(F.col("start"), F.max(F.when(F.col("wide"), F.col("start_b"))).over(one)), "high": F.least(F.col("end"), F.min(F.when(F.col("wide"), F.col("end_b"))).over(one))})
    enclosed = F.col("whole") > enough
    kept = told.where((enclosed & F.col("encloses")) | (~enclosed & (F.col("whole") < F.col("n")) & (F.col("n") > enough)))
    return kept.select("chrom", F.when(enclosed, F.col("start")).otherwise(F.col("low")).alias("start"), F.when(enclosed, F.col("end")).otherwise(F.col("high")).alias("end"), F.col("hap_b").alias("hap"), F.col("start_b").alias("span_start"), F.col("end_b").alias("span_end"))


def haplotype_depths(records: DataFrame, length: float) -> DataFrame:
    """Adds hap_depth = reads * length / span (spans under a read count as one),
    cut to a whole number, and total_depth, the sum over the window before the
    cut. records: chrom, start, end, n_reads, span."""
    depth = F.col("n_reads") * length / F.greatest(F.col("span").cast("double"), F.lit(float(length)))
    total = F.sum(depth).over(Window.partitionBy("chrom", "start", "end"))
    return records.withColumns({"hap_depth": depth.cast("int"), "total_depth": total.cast("int")})


def classified(reads: DataFrame, names: DataFrame, chunk: str) -> DataFrame:
    """Adds tag and kept to primary reads. names: qname, hap, status (correct,
    mismapped, lowqual; others are noisy). Kept: mapped with mapq over 10, of a
    correct name, no duplicate or failure."""
    known = names.select("qname", F.col("hap").alias("__hap"), F.col("status").alias("__status"))
    primary = reads.where(~has(F.col("flag"), SECONDARY | SUPPLEMENTARY)).join(known, "qname", "left")
    status = F.coalesce("__status", F.lit("noisy"))
    tag = haplotype_tag(F.lit(chunk), F.coalesce(F.col("__hap").cast("string"), F.lit("NA")), status.isin("mismapped", "noisy"), status == "lowqual")
    kept = (F.col("mapq") > 10) & ~has(F.col("flag"), UNMAPPED | DUPLICATE | QCFAIL) & (status == "correct")
    return primary.withColumns({"tag": tag, "kept": kept}).drop("__hap", "__status")
