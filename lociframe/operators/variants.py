"""Variant sets: normal form, priority merge, cohort filter, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import binomial_cdf

KEY = ["chrom", "pos", "ref", "alt"]


def normalise(df: DataFrame) -> DataFrame:
    """One row per alternative allele (alts: array), without '*', upper-case,
    exact repeats once."""
    flat = df.withColumn("alt", F.explode("alts")).drop("alts").where("alt <> '*'")
    return flat.withColumns({"ref": F.upper("ref"), "alt": F.upper("alt")}).dropDuplicates(KEY)


def called(df: DataFrame) -> DataFrame:
    """Records with a genotype that has an alternative allele."""
    return df.where(F.coalesce(F.col("gt").rlike(r"[1-9]"), F.lit(False)))


def labelled(df: DataFrame, label: str) -> DataFrame:
    """The source's label as the filter of every record that has a genotype."""
    known = F.coalesce(~F.col("gt").contains("."), F.lit(False))
    return df.withColumn("filter", F.when(known, F.array(F.lit(label))).otherwise(F.col("filter")))


def having(df: DataFrame, *tags: str) -> DataFrame:
    """Records whose filter has any of the tags."""
    return df.where(F.arrays_overlap("filter", F.array(*[F.lit(t) for t in tags])))


def tagged(filters: Column, tag: Column) -> Column:
    """The list with tag at its end, once."""
    return F.concat(F.array_remove(filters, tag), F.array(tag))


def soft_filter(df: DataFrame, condition: Column, tag: str) -> DataFrame:
    """Puts a tag at the end of the filter list where the condition is true."""
    return df.withColumn("filter", F.when(F.coalesce(condition, F.lit(False)), tagged(F.col("filter"), F.lit(tag))).otherwise(F.col("filter")))


def in_regions(variants: DataFrame, regions: DataFrame) -> DataFrame:
    """Variants (1-based pos, span of ref) that overlap a region."""
    from .intervals import semi

    span = variants.withColumns({"start": F.col("pos") - 1, "end": F.col("pos") - 1 + F.length("ref")})
    return semi(span, regions).select(*variants.columns)


def lost_alt(truth: DataFrame) -> DataFrame:
    """Truth without alleles that the data can't show: alt depth missing or at
    most 1, or at most a tenth of the depth, in the realigned reads and in
    either of the two original sets."""

    def weak(name: str) -> Column:
        alt, dp = F.col(f"{name}_alt"), F.col(f"{name}_dp")
        return F.coalesce((alt <= 1) | (alt / F.when(dp > 0, dp) <= 0.1), F.lit(True))

    return truth.where(~(weak("re") & (weak("high") | weak("low"))))


def ratio(alt: Column, ref: Column) -> Column:
    return F.try_divide(alt.cast("double"), (ref + alt).cast("double"))


def fix_matched(ad_ref: Column, ad_alt: Column, gq: Column, hp: Column) -> Column:
    """Homozygous alternative for a matched record; a depth sum of 0 changes
    nothing."""
    r = ratio(ad_alt, ad_ref)
    return F.coalesce((r >= 0.9) | ((hp >= 2) & (r >= 0.7)) | ((gq < 5) & (r >= 0.7) & (ad_ref + ad_alt > 5)), F.lit(False))


def fix_query_only(ad_ref: Column, ad_alt: Column, hp: Column) -> Column:
    r, dp = ratio(ad_alt, ad_ref), ad_ref + ad_alt
    return F.coalesce(((hp >= 2) & (r >= 0.55) & (dp >= 5)) | ((hp >= 4) & (ad_alt >= ad_ref) & (dp >= 5)) | ((r >= 0.9) & (dp >= 5)), F.lit(False))


def fix_reference_only(ad_ref: Column, ad_alt: Column, gq: Column) -> Column:
    return F.coalesce((gq < 5) & (ratio(ad_alt, ad_ref) >= 0.7), F.lit(False))


def merge_priority(query: DataFrame, reference: DataFrame, query_tag: str = "RAW", reference_tag: str = "CLEAN", added: str | None = "MISALIGNED", fix_genotypes: bool = True) -> DataFrame:
    """Full outer merge on (chrom, pos, ref, alt) of normal-form sets with
    columns gt, filter, ad_ref, ad_alt, gq, hp.

    Matched records are the reference's with both tags; those of the query
    alone get its tag and the added filter; those of the reference alone its
    tag. fix_genotypes sets homozygous genotypes by allele depth.
    """
    cols = ["gt", "filter", "ad_ref", "ad_alt", "gq", "hp"]
    q = query.select(*KEY, *[F.col(c).alias(f"q_{c}") for c in cols], F.lit(True).alias("in_q"))
    r = reference.select(*KEY, *[F.col(c).alias(f"r_{c}") for c in cols], F.lit(True).alias("in_r"))
    both = q.join(r, KEY, "full_outer")
    matched, q_only = F.col("in_q").isNotNull() & F.col("in_r").isNotNull(), F.col("in_r").isNull()
    side = F.when(matched, "both").when(q_only, "query").otherwise("reference")
    own = lambda c: F.when(q_only, F.col(f"q_{c}")).otherwise(F.col(f"r_{c}"))
    base = own("filter")
    q_filter = tagged(base, F.lit(query_tag))
    if added:
        q_filter = tagged(q_filter, F.lit(added))
    filters = F.when(matched, tagged(tagged(base, F.lit(query_tag)), F.lit(reference_tag))).when(q_only, q_filter).otherwise(tagged(base, F.lit(reference_tag)))
    gt = own("gt")
    if fix_genotypes:
        gt = (
            F.when(matched & fix_matched(F.col("r_ad_ref"), F.col("r_ad_alt"), F.col("r_gq"), F.col("r_hp")), "1/1")
            .when(q_only & fix_query_only(F.col("q_ad_ref"), F.col("q_ad_alt"), F.col("q_hp")), "1/1")
            .when(~matched & ~q_only & fix_reference_only(F.col("r_ad_ref"), F.col("r_ad_alt"), F.col("r_gq")), "1/1")
            .otherwise(gt)
        )
    return both.select(*KEY, side.alias("side"), gt.alias("gt"), F.array_join(filters, ";").alias("filter"))


def annotate_common(query: DataFrame, cohort: DataFrame, cutoff: float = 0.01, confidence: float = 0.999, tag: str = "INHOUSE_COMMON") -> DataFrame:
    """Query variants with a flag: those whose cohort count (ac of an) is too
    high for a frequency of cutoff. Cohort-only variants are dropped; missing
    counts flag nothing."""
    counts = cohort.select(*KEY, F.col("ac").alias("c_ac"), F.col("an").alias("c_an"))
    both = query.join(counts, KEY, "left")
    common = F.coalesce(binomial_cdf(F.col("c_ac"), F.col("c_an"), cutoff) > confidence, F.lit(False))
    return both.withColumn("tag", F.when(common, tag).otherwise("")).drop("c_ac", "c_an")


def genotype(dp: Column, ad_ref: Column, ad_alt: Column, gt: Column) -> Column:
    """miss without depth, 0 where only the reference has depth, else gt."""
    return F.when(dp.isNull() | (dp == 0), "miss").when((ad_ref > 0) & (ad_alt == 0), "0").otherwise(gt)


def pick_called(calls: DataFrame, preferred: str = "GATK") -> DataFrame:
    """One call per site: with the same genotype or two non-reference ones the
    preferred caller's, else the larger genotype."""
    per_site = Window.partitionBy("chrom", "pos")
    alike = (F.min("gt").over(per_site) == F.max("gt").over(per_site)) | (F.min("gt").over(per_site) > 0)
    order = [F.when(alike & (F.col("caller") == preferred), 0).otherwise(1), F.col("gt").desc(), F.col("caller")]
    return calls.withColumn("__alike", alike).withColumn("__n", F.row_number().over(per_site.orderBy(*order))).where("__n = 1").drop("__n", "__alike")


def precision_recall(truth: DataFrame, called: DataFrame, on: list[str] = KEY) -> DataFrame:
    """One row: counts, recall and precision of called sites under an equality
    (the columns `on`), and how genotypes differ. Null where a set is empty."""
    t = truth.select(*on, F.col("gt").alias("t_gt")).dropDuplicates(on)
    c = called.select(*on, F.col("gt").alias("c_gt")).dropDuplicates(on)
    both = t.join(c, on, "full_outer")
    n = lambda x: F.count(F.when(x, 1))
    hit, in_t, in_c = F.col("t_gt").isNotNull() & F.col("c_gt").isNotNull(), F.col("t_gt").isNotNull(), F.col("c_gt").isNotNull()
    out = both.agg(
        n(in_t).alias("truth"), n(in_c).alias("called"), n(hit).alias("hits"), n(in_c & ~in_t).alias("false_positive"), n(in_t & ~in_c).alias("missed"),
        n(hit & (F.col("t_gt") == F.col("c_gt"))).alias("accurate"), n(hit & (F.col("t_gt") == "0/1") & (F.col("c_gt") == "1/1")).alias("het_as_hom"), n(hit & (F.col("t_gt") == "1/1") & (F.col("c_gt") == "0/1")).alias("hom_as_het"),
    )
    return out.withColumns({"recall": F.try_divide(F.col("hits").cast("double"), "truth"), "precision": F.try_divide(F.col("hits").cast("double"), "called")})


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key; those of new replace those of old. Of several new rows of a
    key the least by all columns stays."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c != "__v"]
    return both.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("__v").desc(), *rest))).where("__n = 1").drop("__n", "__v")


def merge_headers(*headers: DataFrame) -> DataFrame:
    """Header records (kind, id, text) of several files; the first file's win."""
    both = None
    for k, h in enumerate(headers):
        h = h.withColumn("__k", F.lit(k))
        both = h if both is None else both.unionByName(h)
    return both.withColumn("__n", F.row_number().over(Window.partitionBy("kind", "id").orderBy("__k", "text"))).where("__n = 1").drop("__n", "__k")


def haplotype_support(reads: DataFrame, variants: DataFrame) -> DataFrame:
    """Per variant the haplotype tags of reads that show its allele, joined by
    ';' ('.' if none). reads: chrom, pos, base, hp, mapq, bq."""
    shown = reads.where("mapq >= 10 and bq >= 15").select("chrom", "pos", F.col("base").alias("alt"), "hp").distinct()
    found = variants.select(*KEY).join(shown, ["chrom", "pos", "alt"], "left").groupBy(*KEY).agg(F.array_sort(F.collect_set(F.col("hp").cast("string"))).alias("s"))
    return found.select(*KEY, F.when(F.size("s") > 0, F.array_join("s", ";")).otherwise(".").alias("hpsup"))


def allele_depths(bases: DataFrame) -> DataFrame:
    """chrom, pos, base, ad, dp of observed bases."""
    ad = bases.groupBy("chrom", "pos", "base").agg(F.count("*").alias("ad"))
    return ad.withColumn("dp", F.sum("ad").over(Window.partitionBy("chrom", "pos")))


def annotate(df: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """df with columns of the same variant in other (one row per variant)."""
    return df.join(other.select(*KEY, *columns), KEY, "left")


def depth_lookup(truth: DataFrame, **tables: DataFrame) -> DataFrame:
    """Adds name_dp and name_alt from each allele depth table (chrom, pos, base,
    ad, dp): a missing allele has depth 0; without any depth both are null."""
    out = truth
    for name, table in tables.items():
        total = table.groupBy("chrom", "pos").agg(F.max("dp").alias(f"{name}_dp"))
        own = table.select("chrom", "pos", F.col("base").alias("alt"), F.col("ad").alias(f"{name}_alt"))
        out = out.join(total, ["chrom", "pos"], "left").join(own, ["chrom", "pos", "alt"], "left")
        out = out.withColumn(f"{name}_alt", F.when(F.col(f"{name}_dp") > 0, F.coalesce(f"{name}_alt", F.lit(0))))
    return out


#: Which columns make two records equal.
EQUALITIES = {"site": ["chrom", "pos"], "rough": KEY, "exact": [*KEY, "gt"]}


def members(df: DataFrame, other: DataFrame, equality: str = "rough") -> DataFrame:
    """Rows of df that other has too, by site, variant or genotype."""
    keys = EQUALITIES[equality]
    return df.join(other.select(*keys).distinct(), keys, "left_semi")
