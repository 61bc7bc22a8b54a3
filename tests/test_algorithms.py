"""Sequential algorithms and vectors against brute force on small inputs."""

import itertools
import random

from pyspark.sql import functions as F

from lociframe.functions import scalars as sc
from lociframe.operators import graphs, intervals, reads
from lociframe.sources import formats


def test_read_vector(spark):
    df = spark.createDataFrame([("10=1X2I5=",), ("2I3=",), ("3=2I",), ("2=1D1I2=",)], "c string")
    got = [r[0] for r in df.select(sc.read_vector(sc.cigar_ops(F.col("c")))).collect()]
    assert got == [[1] * 10 + [-4, 8] + [1] * 4, [1] * 3, [1] * 3, [1, 1, -6, 4, 1]]


def test_query_index_and_identity(spark):
    df = spark.createDataFrame([("2S3=1D2=",)], "c string").withColumn("o", sc.cigar_ops(F.col("c")))
    r = df.select(sc.query_index(F.col("o")).alias("q"), sc.identity(F.col("o")).alias("i"), sc.reference_length(F.col("o")).alias("n")).first()
    assert (r.q, r.i, r.n) == ([2, 3, 4, -1, 5, 6], 0.8333, 6)


def test_binomial(spark):
    df = spark.createDataFrame([(0, 10), (3, 10), (10, 10), (5, 5000), (None, 3)], "k int, n int")
    from math import comb

    want = [None if k is None else sum(comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1)) for k, n in ((0, 10), (3, 10), (10, 10), (5, 5000), (None, 3))]
    got = [r[0] for r in df.select(sc.binomial_cdf(F.col("k"), F.col("n"), 0.01)).collect()]
    assert all(a is b is None or abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))


def test_trimmed_variant(spark):
    df = spark.createDataFrame([(10, "CAAA", "CA"), (5, "A", "G"), (7, "GTC", "GAC")], "p int, r string, a string")
    got = [tuple(x[0]) for x in df.select(sc.trimmed_variant(F.col("p"), F.col("r"), F.col("a"))).collect()]
    assert got == [(10, "CAA", "C"), (5, "A", "G"), (8, "T", "A")]


def test_best_drops_is_exact():
    rng = random.Random(1)
    for _ in range(60):
        haps = list(range(rng.randint(1, 8)))
        gain = {h: rng.randint(1, 9) for h in haps}
        limits = [(frozenset(rng.sample(haps, rng.randint(1, len(haps)))), rng.randint(0, 3)) for _ in range(4)]
        fits = [set(c) for k in range(len(haps) + 1) for c in itertools.combinations(haps, k) if all(len(set(c) & m) <= n for m, n in limits)]
        assert sum(gain[h] for h in graphs.best_drops(gain, limits)) == max(sum(gain[h] for h in c) for c in fits)


def test_cliques_hold_no_conflict():
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randint(1, 12)
        weights = {(a, b): rng.choice([-1, 0.1, 0.3, 0.6, 0.9]) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6}
        cliques = graphs.grow_cliques(weights, list(range(n)), 0.25)
        assert sorted(itertools.chain(*cliques)) == list(range(n))
        assert all(weights.get(p) != -1 for c in cliques for p in itertools.combinations(c, 2))


def test_colours_and_paths(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y")]
    e = graphs.checkpointed(spark.createDataFrame(edges, "a string, b string"))
    parts = graphs.checkpointed(graphs.components(e))
    assert {r.id: r.component for r in parts.collect()} == {**dict.fromkeys("abcd", "a"), "x": "x", "y": "x"}
    with_part = graphs.checkpointed(e.join(parts.select(F.col("id").alias("a"), "component"), "a").select("a", "b", "component", F.lit(0.1).alias("weight"), (F.col("b") == "d").alias("overlap")))
    colour = {r.id: r.colour for r in graphs.colours(with_part, parts).collect()}
    assert all(colour[a] != colour[b] for a, b in edges) and max(colour.values()) == 2
    paths = {(r.source, r.target): r for r in graphs.shortest_paths(with_part, spark.createDataFrame([("a", "a")], "source string, component string")).collect()}
    assert paths["a", "d"].path == "a>c>d" and not paths["a", "d"].valid and paths["a", "c"].valid


def test_umbrella(spark):
    rows = [(1, "c", 0, 100, "d", 0, 100, "+", "+", 5), (1, "c", 10, 90, "d", 10, 90, "+", "+", 5), (1, "c", 10, 90, "e", 10, 90, "+", "+", 5)]
    df = spark.createDataFrame(rows, "g int, chr_1 string, start_1 int, end_1 int, chr_2 string, start_2 int, end_2 int, strand1 string, strand2 string, overlap_len int")
    assert {(r.start_1, r.chr_2) for r in graphs.drop_umbrellas(df, "g").collect()} == {(10, "d"), (10, "e")}


def test_umbrella_with_columns_of_any_name(spark):
    rows = [(1, "c", 0, 100, "d", 0, 100, "+", "+", 5, 7, 8), (1, "c", 10, 90, "d", 10, 90, "+", "+", 5, 7, 8), (2, "c", 0, 100, "d", 0, 100, "+", "+", 5, 7, 8)]
    df = spark.createDataFrame(rows, "r int, chr_1 string, start_1 int, end_1 int, chr_2 string, start_2 int, end_2 int, strand1 string, strand2 string, overlap_len int, g int, outer int")
    got = graphs.drop_umbrellas(df, "r")
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(rows[1:])


def test_intervals_brute_force(spark):
    rng = random.Random(3)
    a = [("c", s, s + rng.randint(1, 90)) for s in (rng.randint(0, 400) for _ in range(40))]
    b = [("c", s, s + rng.randint(1, 90)) for s in (rng.randint(0, 400) for _ in range(30))]
    x, y = (spark.createDataFrame(v, "chrom string, start int, end int") for v in (a, b))
    bases = lambda v: {p for _, s, e in v for p in range(s, e)}
    merged = [tuple(r) for r in intervals.merge(x).collect()]
    assert bases(merged) == bases(a) and sum(e - s for _, s, e in merged) == len(bases(a))
    left = [tuple(r) for r in intervals.subtract(x.distinct(), y, ("chrom",)).select("chrom", "start", "end").collect()]
    assert bases(left) == bases(a) - bases(b)
    hits = sorted(tuple(r) for r in intervals.overlaps(x, y).select("start", "end", "start_b", "end_b").collect())
    assert hits == sorted((s, e, t, f) for _, s, e in a for _, t, f in b if s < f and t < e)
    assert intervals.merge(x.limit(0)).count() == 0


def test_lift_relative(spark):
    q = spark.createDataFrame([(1, "c", 100, 200, "+")], "group int, chrom string, start int, end int, strand string")
    other = spark.createDataFrame([(1, "d", 500, 600, "+"), (1, "e", 700, 800, "-")], "group int, chrom string, start int, end int, strand string")
    t = spark.createDataFrame([("c", 120, 130)], "chrom string, start int, end int")
    assert sorted(tuple(r)[1:] for r in intervals.lift_relative(q, other, t, 5).collect()) == [("d", 515, 535), ("e", 765, 785)]


def test_noisy(spark):
    rows = [(256, 0, 10), (4, 60, 100), (1, 60, 50), (1, 60, 100), (1024, 60, 100)]
    df = spark.createDataFrame(rows, "flag int, mapq int, span int")
    got = [r[0] for r in df.select(reads.noisy(F.col("flag"), F.col("mapq"), F.col("span"), F.lit(False))).collect()]
    assert got == [False, True, True, False, True]


def test_formats(spark, tmp_path):
    (tmp_path / "a.vcf").write_text('##INFO=<ID=AC,Number=1>\n#CHROM\nchr1\t5\t.\tA\tC,G\t9.5\tLOW\tAC=3;DB\tGT\t0/1\n')
    r = formats.read_vcf(spark, str(tmp_path / "a.vcf")).first()
    assert (r.chrom, r.pos, r.id, r.alts, r.filter, r.info["AC"], r.samples) == ("chr1", 5, None, ["C", "G"], ["LOW"], "3", ["0/1"])
    assert formats.read_vcf_header(spark, str(tmp_path / "a.vcf")).first().id == "AC"
    (tmp_path / "a.sam").write_text("@HD\nq1\t67\tchr1\t11\t60\t5=1X\t=\t30\t25\tACGTAC\tIIIIII\tNM:i:1\n")
    s = formats.read_sam(spark, str(tmp_path / "a.sam")).first()
    assert (s.start, s.end, s.mate_chrom, s.tags["NM"], s.quals[0]) == (10, 16, "chr1", "1", 40)
    bed = formats.bed_of(spark, "c\t1\t5\nd\t2\t9\n")
    formats.write_bed(bed, str(tmp_path / "bed"))
    assert sorted(map(tuple, formats.read_bed(spark, str(tmp_path / "bed")).collect())) == [("c", 1, 5), ("d", 2, 9)]
    edges = spark.createDataFrame([("a", "b", "overlap", 0.5)], "a string, b string, type string, weight double")
    assert formats.read_graphml(formats.graphml_lines(edges)).collect() == edges.collect()
