"""Column functions: text forms, CIGAR strings, read vectors, distributions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- text forms -----------------------------------------------------------------

#: What counts as not available.
NA_PATTERN = r"^(?:(?:NA|NaN|nan)(?:[,;|&/](?:NA|NaN|nan))*|[.\-*_ ]*)$"


def is_na(c: Column) -> Column:
    """Null, an NA word, a delimiter-joined list of NA words, or only . - * _
    and spaces (the empty string too)."""
    return c.isNull() | F.coalesce(c.rlike(NA_PATTERN), F.lit(True))


def region_text(chrom: Column, start: Column, end: Column, strand: Column | None = None) -> Column:
    parts = F.format_string("%s:%d-%d", chrom, start.cast("long"), end.cast("long"))
    return parts if strand is None else F.concat(parts, F.lit(":"), strand)


def parse_region(c: Column) -> Column:
    """struct(chrom, start, end, strand) of chrom:start-end[:strand]; null parts
    if it doesn't fit."""
    p = r"^(\S+?):(\d+)-(\d+)(?::(.+))?$"
    part = lambda i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    return F.struct(part(1).alias("chrom"), part(2).cast("int").alias("start"), part(3).cast("int").alias("end"), part(4).alias("strand"))


def pad_region(c: Column, k: int) -> Column:
    """The region text padded by k at both ends, without clipping."""
    r = parse_region(c)
    return region_text(r["chrom"], r["start"] - k, r["end"] + k)


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGTacgt", "TGCAtgca"))


def masked(seq: Column, k: int = 1000) -> Column:
    """The sequence with its first and last k bases replaced by N."""
    n = F.length(seq)
    inner = seq.substr(F.lit(k + 1), F.greatest(n - 2 * k, F.lit(0)))
    return F.concat(F.repeat(F.lit("N"), F.least(F.lit(k), n)), inner, F.repeat(F.lit("N"), F.least(F.lit(k), F.greatest(n - k, F.lit(0)))))


def is_main_contig(c: Column) -> Column:
    return c.rlike(r"(?i)^(chr)?([0-9]+|[XYM]|MT)$")


def is_annotated_contig(c: Column) -> Column:
    """The stricter gate of cohort annotation: chr and digits or M, T, X, Y."""
    return c.rlike(r"^chr[0-9MTXY]+$")


def parse_node(c: Column) -> Column:
    """struct(chrom, start, end, strand) of a node text ('chr1', 10, 20, '+')."""
    p = r"^\(\s*['\"]([^'\"]+)['\"]\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*['\"]([^'\"]*)['\"]\s*\)$"
    part = lambda i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    return F.struct(part(1).alias("chrom"), part(2).cast("int").alias("start"), part(3).cast("int").alias("end"), part(4).alias("strand"))


def assembly(c: Column) -> Column:
    """hg19, hg38 or chm13 by parts of a file name."""
    low = F.lower(c)
    return F.when(low.rlike("hg19|grch37"), "hg19").when(low.rlike("hg38|grch38"), "hg38").when(low.rlike("chm13|t2t"), "chm13")


def group_label(c: Column) -> Column:
    """RGn of an integer, digits or RGn; raises an error for others."""
    t = c.cast("string")
    return F.when(t.rlike(r"^\d+$"), F.concat(F.lit("RG"), t)).when(t.rlike(r"^RG\d+$"), t).otherwise(F.raise_error(F.concat(F.lit("no group label: "), F.coalesce(t, F.lit("null")))).cast("string"))


def sample_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/.]+)[^/]*$", 1)


def haplotype_tag(chunk: Column, hap: Column, dense: Column, low: Column) -> Column:
    return F.when(low, "LOWQUAL").otherwise(F.concat(F.lit("chunk"), chunk.cast("string"), F.lit("_"), hap.cast("string"), F.when(dense, "_HIGHVD").otherwise("")))


def trimmed_variant(pos: Column, ref: Column, alt: Column) -> Column:
    """struct(pos, ref, alt) without common ends, one base kept on each side."""
    n = F.least(F.length(ref), F.length(alt))
    right = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i == n - 1) | (ref.substr(F.length(ref) - i, F.lit(1)) != alt.substr(F.length(alt) - i, F.lit(1))))), F.lit(0))
    r, a = ref.substr(F.lit(1), F.length(ref) - right), alt.substr(F.lit(1), F.length(alt) - right)
    m = F.least(F.length(r), F.length(a))
    left = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), lambda i: (i == m - 1) | (r.substr(i + 1, F.lit(1)) != a.substr(i + 1, F.lit(1))))), F.lit(0))
    return F.struct((pos + left).alias("pos"), r.substr(left + 1, F.length(r)).alias("ref"), a.substr(left + 1, F.length(a)).alias("alt"))


def compare_loci(chrom_a, start_a, stop_a, chrom_b, start_b, stop_b) -> Column:
    """-1: a is before b, 1: after, 0: the same span, 2: overlapping otherwise."""
    return (
        F.when(chrom_a < chrom_b, -1).when(chrom_a > chrom_b, 1)
        .when((start_a == start_b) & (stop_a == stop_b), 0)
        .when(stop_a <= start_b, -1).when(start_a >= stop_b, 1).otherwise(2)
    )


# --- CIGAR ------------------------------------------------------------------------


def cigar_ops(c: Column) -> Column:
    """array<struct<len: int, op: string>> of a CIGAR string."""
    lens = F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1)), lambda x: x.cast("int"))
    ops = F.regexp_extract_all(c, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1))
    return F.arrays_zip(lens.alias("len"), ops.alias("op"))


def _sum(ops: Column, kinds: str) -> Column:
    fits = F.filter(ops, lambda x: x["op"].isin(*kinds))
    return F.aggregate(fits, F.lit(0), lambda s, x: s + x["len"])


def reference_length(ops: Column) -> Column:
    return _sum(ops, "MDN=X")


def soft_clipped(ops: Column) -> Column:
    return _sum(ops, "S")


def longest_gap(ops: Column) -> Column:
    """The longest insertion or deletion of more than one base, else 0."""
    return F.coalesce(F.array_max(F.transform(F.filter(ops, lambda x: x["op"].isin("I", "D") & (x["len"] > 1)), lambda x: x["len"])), F.lit(0))


def identity(ops: Column) -> Column:
    """Matches over aligned columns, to four decimals."""
    return F.round(F.try_divide(_sum(ops, "=").cast("double"), _sum(ops, "=XID").cast("double")), 4)


def aligned_blocks(ops: Column, start: Column) -> Column:
    """array<struct<s, e>> of the reference spans under M, = and X."""
    zero = F.struct(start.cast("int").alias("at"), F.expr("cast(array() as array<struct<s:int,e:int>>)").alias("all"))

    def step(a, x):
        to = a["at"] + F.when(x["op"].isin(*"MDN=X"), x["len"]).otherwise(0)
        hit = F.array(F.struct(a["at"].alias("s"), to.alias("e")))
        return F.struct(to.alias("at"), F.when(x["op"].isin(*"M=X"), F.concat(a["all"], hit)).otherwise(a["all"]).alias("all"))

    return F.aggregate(ops, zero, step, lambda a: a["all"])


#: Fixed values of a read vector: match, mismatch, deletion; an insertion of n
#: bases puts 4 n on the next reference base.
MATCH, MISMATCH, DELETED, PER_INSERTED = 1, -4, -6, 4


def read_vector(ops: Column, seq: Column | None = None) -> Column:
    """array<int> over the reference span of a CIGAR with = and X (M raises an
    error). Insertions before the first or after the last base vanish. With the
    read's bases, a single mismatch that reads N is a match."""
    zero = F.struct(F.expr("cast(array() as array<int>)").alias("v"), F.lit(0).alias("ins"), F.lit(0).alias("q"))

    def step(a, x):
        unread = F.lit(False) if seq is None else (x["len"] == 1) & (F.upper(seq.substr(a["q"] + 1, F.lit(1))) == "N")
        value = F.when((x["op"] == "X") & ~F.coalesce(unread, F.lit(False)), MISMATCH).when(x["op"] == "D", DELETED).otherwise(MATCH)
        span = F.when(a["ins"] > 0, F.concat(F.array(a["ins"]), F.array_repeat(value, x["len"] - 1))).otherwise(F.array_repeat(value, x["len"]))
        spans = x["op"].isin("=", "X", "D", "N")
        v = F.when(spans & (x["len"] > 0), F.concat(a["v"], span)).when(x["op"] == "M", F.raise_error(F.lit("CIGAR must tell = from X")).cast("array<int>")).otherwise(a["v"])
        ins = F.when(spans, 0).when((x["op"] == "I") & (F.size(a["v"]) > 0), x["len"] * PER_INSERTED).otherwise(a["ins"])
        return F.struct(v.alias("v"), ins.cast("int").alias("ins"), (a["q"] + F.when(x["op"].isin("=", "X", "I", "S"), x["len"]).otherwise(0)).alias("q"))

    return F.aggregate(ops, zero, step, lambda a: a["v"])


def error_vector(ops: Column, quals: Column) -> Column:
    """array<double> of 10^(-q/10) over the reference span; 0 in gaps and on
    the base before an insertion."""
    zero = F.struct(F.expr("cast(array() as array<double>)").alias("v"), F.lit(0).alias("q"))

    def step(quals, a, x):
        own = F.transform(F.slice(quals, a["q"] + 1, x["len"]), lambda q: F.pow(F.lit(10.0), -q.cast("double") / 10))
        v = (
            F.when(x["op"].isin("=", "X"), F.concat(a["v"], own))
            .when(x["op"].isin("D", "N"), F.concat(a["v"], F.array_repeat(F.lit(0.0), x["len"])))
            .when((x["op"] == "I") & (F.size(a["v"]) > 0), F.concat(F.slice(a["v"], 1, F.greatest(F.size(a["v"]) - 1, F.lit(0))), F.array(F.lit(0.0))))
            .otherwise(a["v"])
        )
        return F.struct(v.alias("v"), (a["q"] + F.when(x["op"].isin("=", "X", "I", "S", "M"), x["len"]).otherwise(0)).alias("q"))

    # qualities may be worked out by an expression: once a read, not once an operation
    return bound(quals, lambda known: F.aggregate(ops, zero, lambda a, x: step(known, a, x), lambda a: a["v"]))


def query_index(ops: Column) -> Column:
    """array<int>: for each reference position the place in the read, -1 in
    gaps."""
    zero = F.struct(F.expr("cast(array() as array<int>)").alias("v"), F.lit(0).alias("q"))

    def step(a, x):
        v = (
            F.when(x["op"].isin("=", "X", "M") & (x["len"] > 0), F.concat(a["v"], F.sequence(a["q"], a["q"] + x["len"] - 1)))
            .when(x["op"].isin("D", "N"), F.concat(a["v"], F.array_repeat(F.lit(-1), x["len"])))
            .otherwise(a["v"])
        )
        return F.struct(v.alias("v"), (a["q"] + F.when(x["op"].isin("=", "X", "I", "S", "M"), x["len"]).otherwise(0)).alias("q"))

    return F.aggregate(ops, zero, step, lambda a: a["v"])


def bound(value: Column, body) -> Column:
    """body(value) with value worked out once, also where lambdas use it."""
    return F.get(F.transform(F.array(value), body), 0)


def runs(vector: Column, fits) -> Column:
    """The number of maximal runs of entries that fit."""
    def of(flags: Column) -> Column:
        return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(flags), F.lit(1))), lambda i: (F.size(flags) > 0) & F.coalesce(F.get(flags, i - 1), F.lit(False)) & ((i == 1) | ~F.coalesce(F.get(flags, i - 2), F.lit(False)))))

    return bound(F.transform(vector, fits), of)


def count_snv(vector: Column) -> Column:
    return runs(vector, _is_snv)


def count_indel(vector: Column) -> Column:
    return runs(vector, _is_indel)


def _is_snv(v: Column) -> Column:
    return v == MISMATCH


def _is_indel(v: Column) -> Column:
    return (v == DELETED) | (v > MATCH)


class _Rows:
    """The vectors of an Arrow batch, end to end: their places and the blocks
    (runs of entries that fit) that begin before each place."""

    def __init__(self, column):
        import numpy as np

        self.n = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
        flat = column.flatten()
        known, v = np.asarray(flat.is_valid()), np.asarray(flat.fill_null(MATCH), dtype=np.int64)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        first = np.cumsum(self.n) - self.n
        self.low, self.high = first[self.row], (first + self.n)[self.row]
        self.at = np.arange(len(v))
        self.opening = self.at == self.low
        self.fits, self.sums = [], []
        for fits in (v == MISMATCH, (v == DELETED) | (v > MATCH)):
            plain = np.empty(len(v), dtype=bool)
            plain[:1], plain[1:] = True, known[:-1] & ~fits[:-1]
            self.fits.append(fits)
            self.sums.append(np.concatenate([[0], np.cumsum(fits & (self.opening | plain))]))

    def blocks(self, kind: int, low, high):
        """Blocks within [low, high) of places; one may begin before low."""
        import numpy as np

        inside = low < high
        low = np.where(inside, low, 0)
        return np.where(inside, self.sums[kind][high] - self.sums[kind][low + 1] + self.fits[kind][low], 0)

    def densities(self, padding: int):
        import numpy as np

        if not len(self.at):
            return np.zeros(0)
        low, high = np.maximum(self.at - padding, self.low), np.minimum(self.at + padding, self.high)
        return (self.blocks(0, low, high) + self.blocks(1, low, high)) / (2.0 * padding + 1)


def densities(vector: Column, padding: int) -> Column:
    """At each place i, variant blocks in [i - padding, i + padding) (cut at the
    ends) over 2 padding + 1."""

    @F.arrow_udf("array<double>")
    def of(column: pa.Array) -> pa.Array:
        import numpy as np

        rows = _Rows(column)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rows.n)]), pa.int32()), pa.array(rows.densities(padding)))

    return of(vector.cast("array<int>"))


#: Padding, variants and positions that make a place crowded.
CROWDED = ((42, 5, 85), (65, 6, 131), (74, 12, 148))


def extreme_density(vector: Column) -> Column:
    """Whether the variants crowd: a stretch at +-42 of a density from 5/85 on
    that holds, with its padding, over one indel; the same at +-65 from 6/131
    on; or a place at +-74 from 12/148 on."""

    @F.arrow_udf("boolean")
    def of(column: pa.Array) -> pa.Array:
        import numpy as np

        rows = _Rows(column)
        found = np.zeros(len(rows.n), dtype=bool)
        for padding, most, size in CROWDED:
            dense = rows.densities(padding) >= most / size
            if size != CROWDED[-1][2] and dense.any():
                before, after = np.roll(dense, 1), np.roll(dense, -1)
                start = np.flatnonzero(dense & (rows.opening | ~before))
                end = np.flatnonzero(dense & ((rows.at == rows.high - 1) | ~after))
                low, high = np.maximum(start - padding, rows.low[start]), np.minimum(end + padding, rows.high[start])
                found[rows.row[start[rows.blocks(1, low, high) > 1]]] = True
            elif size == CROWDED[-1][2]:
                found[rows.row[dense]] = True
        return pa.array(found)

    return of(vector.cast("array<int>"))


def stretches(flags: Column) -> Column:
    """array<struct<start, end>> of the maximal runs of true, end inclusive."""

    def of(f: Column) -> Column:
        at = lambda i: F.coalesce(F.get(f, i), F.lit(False))
        places = F.when(F.size(f) > 0, F.sequence(F.lit(0), F.greatest(F.size(f) - 1, F.lit(0)))).otherwise(F.expr("cast(array() as array<int>)"))
        opens = F.filter(places, lambda i: at(i) & ((i == 0) | ~at(F.greatest(i - 1, F.lit(0)))))
        closes = F.filter(places, lambda i: at(i) & ~at(i + 1))
        return F.zip_with(opens, closes, lambda s, e: F.struct(s.alias("start"), e.alias("end")))

    return bound(flags, of)


def reference_similarity(vector: Column, genomic: Column) -> Column:
    """struct(size, other): variant blocks of the read's vector, and runs where
    the genomic vector differs from it; both 0 if the genomic one is all
    matches."""
    plain = F.forall(genomic, lambda v: v == MATCH)
    unlike = runs(F.zip_with(vector, genomic, lambda x, y: ~x.eqNullSafe(y)), lambda f: f)
    return F.struct(F.when(plain, 0).otherwise(count_snv(vector) + count_indel(vector)).alias("size"), F.when(plain, 0).otherwise(unlike).alias("other"))


def adjusted_strand(strand1: Column, relative: Column) -> Column:
    """The strand of a pair's side 2 from the strand of its side 1 and their
    relative strand; unchanged where side 1 has none."""
    return F.when(strand1 == "-", F.when(relative == "+", "-").when(relative == "-", "+").otherwise(relative)).otherwise(relative)


#: Codes of bases; any other base is 4.
BASES = "ATCG"


def encoded(seq: Column) -> Column:
    """array<int> of the bases of a sequence: A 0, T 1, C 2, G 3, others 4."""
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.coalesce(F.nullif(F.position(F.upper(c), F.lit(BASES)), F.lit(0)) - 1, F.lit(4)))


def interval_sequence(codes: Column, index: Column, low: Column, high: Column) -> Column:
    """The part of an encoded read that reference places [low, high) of its span
    align to, from its index (see query_index); gaps at both ends are skipped
    inward, and a wholly deleted interval is empty."""
    def of(place: Column) -> Column:
        own = F.filter(F.slice(place["index"], place["low"] + 1, F.greatest(place["high"] - place["low"], F.lit(0))), lambda q: q >= 0)
        return bound(own, lambda o: F.when(F.size(o) > 0, F.slice(codes, F.get(o, 0) + 1, F.element_at(o, -1) - F.get(o, 0) + 1)).otherwise(F.slice(codes, 1, 0)))

    # each argument once, though the place is asked for several times
    return bound(F.struct(index.alias("index"), low.alias("low"), high.alias("high")), of)


def verdict(values: Column) -> Column:
    """Of votes 1, 0 and -1: whether there is a 1 and no -1."""
    return F.exists(values, lambda v: v == 1) & F.forall(values, lambda v: v != -1)


def vetoed(values: Column) -> Column:
    return F.exists(values, lambda v: v == -1)


def differing(a: Column, b: Column) -> Column:
    """Places (from 0) where two arrays of one length differ."""
    return F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.get(a, i) != F.get(b, i))


def equal_but_n(a: Column, b: Column, unknown: int = 4) -> Column:
    """Equal encoded sequences, an unknown base equal to any."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: (x == y) | (x == unknown) | (y == unknown)), lambda x: F.coalesce(x, F.lit(False)))


def shared_snv(a: Column, b: Column) -> Column:
    """Places where both vectors have a mismatch."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == MISMATCH) & (y == MISMATCH)), lambda x: F.coalesce(x, F.lit(False))))


def sequencing_error(base_quality: Column, ad: Column, dp: Column) -> Column:
    """A base that looks like an artefact: quality under 13 and hardly any
    support in the allele depths (a missing allele has depth 0)."""
    depth = F.coalesce(ad, F.lit(0))
    return (base_quality < 13) & (dp > 0) & ((depth / dp <= 0.02) | ((depth == 1) & (dp >= 10)))


def overlap_fraction(overlap: Column, size_a: Column, size_b: Column) -> Column:
    return F.greatest(overlap / size_a, overlap / size_b)


def same_pair(a: Column, b: Column) -> Column:
    """Whether two pairs (structs of chr_i, start_i, end_i, strandi) are one,
    maybe with their sides swapped, in the same relative strand."""
    side = lambda x, i: F.struct(x[f"chr_{i}"], x[f"start_{i}"], x[f"end_{i}"])
    strand = (a["strand1"] == a["strand2"]) == (b["strand1"] == b["strand2"])
    straight = (side(a, 1) == side(b, 1)) & (side(a, 2) == side(b, 2))
    return strand & (straight | ((side(a, 1) == side(b, 2)) & (side(a, 2) == side(b, 1))))


def similarity_score(size: Column, other: Column) -> Column:
    """(v - a) + v / a, or v for the last part where a is 0."""
    return (size - other) + F.when(other > 0, size / other).otherwise(size.cast("double"))


# --- distributions -------------------------------------------------------------------


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k), summed in logarithms, so that (1 - p) ** n can't underflow."""
    import math

    odds = math.log(p / (1 - p))
    zero = F.struct((n * math.log1p(-p)).cast("double").alias("l"), F.exp((n * math.log1p(-p)).cast("double")).alias("s"))

    def step(a, i):
        ln = a["l"] + F.ln((n - i + 1).cast("double") / i) + odds
        return F.struct(ln.alias("l"), (a["s"] + F.exp(ln)).alias("s"))

    inside = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(k, n - 1), F.lit(1))), zero, step, lambda a: F.least(a["s"], F.lit(1.0)))
    return F.when(k.isNull() | n.isNull(), F.lit(None).cast("double")).when(k < 0, 0.0).when(k >= n, 1.0).when(k == 0, F.exp((n * math.log1p(-p)).cast("double"))).otherwise(inside)


def poisson_quantile(rate: Column, level: float, most: int = 1000) -> Column:
    """The smallest k <= most with P(X <= k) >= level."""
    zero = F.struct(F.exp(-rate).alias("t"), F.exp(-rate).alias("s"), F.lit(0).alias("k"))
    step = lambda a, i: F.when(a["s"] >= level, a).otherwise(F.struct((a["t"] * rate / i).alias("t"), (a["s"] + a["t"] * rate / i).alias("s"), i.alias("k")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), zero, step, lambda a: a["k"])
