"""Phasing, counterparts and groups against brute force on small inputs."""

import random

from pyspark.sql import functions as F

from lociframe.functions import scalars as sc
from lociframe.operators import paralogs, phasing, reads, variants

BASES = "ACGT"


def _random_read(rng, genome, name, k):
    """A read as parts (cells by position), its CIGAR, bases and qualities."""
    start, pos, seq, ops, cells, vec = rng.randint(0, 30), 0, "", [], [], []
    pos = start
    for j in range(rng.randint(1, 4)):
        n = rng.randint(3, 15)
        seq += genome[pos : pos + n]
        cells += list(genome[pos : pos + n])
        vec += [1] * n
        ops.append(f"{n}=")
        pos += n
        kind = rng.choice("XID=")
        if kind == "X":
            b = rng.choice([x for x in BASES if x != genome[pos]])
            seq, pos = seq + b, pos + 1
            cells.append(b)
            vec.append(-4)
            ops.append("1X")
        elif kind == "I":
            seq += "GG"
            cells[-1] += "GG"
            ops.append("2I")
            vec.append(None)
        elif kind == "D":
            cells += ["-", "-"]
            vec += [-6, -6]
            pos += 2
            ops.append("2D")
        if kind == "I":
            vec.pop()
            n = 3
            seq += genome[pos : pos + n]
            cells += list(genome[pos : pos + n])
            vec += [8, 1, 1]
            ops.append("3=")
            pos += n
    quals = [rng.choice([8, 30]) for _ in seq]
    return {"id": f"{name}/{k}", "qname": name, "chrom": "c", "start": start, "cigar": "".join(ops), "seq": seq, "quals": quals}, cells, vec


def test_phase_edges_brute_force(spark):
    rng = random.Random(5)
    genome = "".join(rng.choice(BASES) for _ in range(200))
    made = [_random_read(rng, genome, q, k) for q in range(1, 25) for k in range(2)]
    depth = {(p, b): rng.choice([0, 1, 30]) for p in range(120) for b in BASES}
    total = {p: sum(depth[p, b] for b in BASES) for p in range(120)}
    copies = {(p, b) for p in range(120) for b in BASES if rng.random() < 0.5}
    df = spark.createDataFrame([m[0] for m in made], "id string, qname long, chrom string, start int, cigar string, seq string, quals array<int>")
    table = "chrom string, pos int, base string, ad int, dp int"
    depths = spark.createDataFrame([("c", p, b, n, total[p]) for (p, b), n in depth.items() if n], table)
    intrinsic = spark.createDataFrame([("c", p, b, 1, 1) for p, b in copies], table)
    told = phasing.described(df, depths, intrinsic).cache()
    by_id = {r.id: r for r in told.collect()}
    for r, cells, vec in made:
        assert by_id[r["id"]].cells == cells and by_id[r["id"]].vec == vec

    def weak(r, at):
        pos = r["start"] + at
        cells = by_id[r["id"]].cells
        q = r["quals"][sum(len(c.replace("-", "")) for c in cells[:at])]
        dp, ad = total.get(pos, 0), depth.get((pos, cells[at][0]), 0)
        return q < 13 and dp > 0 and (ad / dp <= 0.02 or (ad == 1 and dp >= 10))

    def runs(v):
        f = [x == -6 or x > 1 for x in v]
        return sum(x and (i == 0 or not f[i - 1]) for i, x in enumerate(f))

    want: dict = {}
    for a, ca, va in made:
        for b, cb, vb in made:
            low, high = max(a["start"], b["start"]), min(a["start"] + len(va), b["start"] + len(vb))
            if a["qname"] >= b["qname"] or low >= high:
                continue
            spots = [(p - a["start"], p - b["start"]) for p in range(low, high)]
            unlike = [(i, j) for i, j in spots if ca[i] != cb[j]]
            same = sum(va[i] != vb[j] for i, j in spots) < 3 and all(len(ca[i]) == len(cb[j]) == 1 and "-" not in (ca[i], cb[j]) and (weak(a, i) or weak(b, j)) for i, j in unlike)
            alike = [va[i] for i, j in spots if va[i] == vb[j]]
            shared = [(i, j) for i, j in spots if va[i] == vb[j] == -4]
            copied = sum(ca[i] == cb[j] and (a["start"] + i, ca[i][0]) in copies for i, j in shared)
            n = len(shared)
            w = len(alike) + sum(20 * (i + 1) for i in range(n)) + 0.75 * 20 * (n - copied) + 60 * runs(alike) - 20 * len(unlike)
            want.setdefault((a["qname"], b["qname"]), []).append(w if same else None)
    edges = {k: -1.0 if None in v else max(sum(v) / 200, 1e-4) for k, v in want.items()}
    got = {(r.a, r.b): r.weight for r in phasing.phase_edges(phasing.compared_pairs(told, 20.0, 16), 20.0).collect()}
    assert got.keys() == edges.keys() and all(abs(got[k] - edges[k]) < 1e-9 for k in got)
    assert -1.0 in got.values() and max(got.values()) > 0


def test_routes():
    node = lambda s, e, strand="+": {"start": s, "end": e, "strand": strand}
    assert paralogs.forward((10, 40), node(0, 100), node(500, 600), False, 5) == (10, 40)
    assert paralogs.forward((10, 40), node(0, 100), node(500, 600, "-"), False, 5) == (60, 90)
    assert paralogs.forward((10, 40), node(0, 100), node(20, 90), True, 5) == (0, 20)
    assert paralogs.forward((10, 24), node(0, 100), node(20, 90), True, 5) is None
    assert paralogs.backward((60, 90), node(500, 600, "-"), node(0, 100), False) == (10, 40)
    assert paralogs.backward((0, 20), node(20, 90), node(0, 100), True) == (20, 40)


def test_counterparts_and_groups(spark):
    nodes = spark.createDataFrame([("a", "c", 0, 100, "+", "a"), ("b", "d", 0, 100, "-", "a"), ("x", "d", 50, 90, "-", "a"), ("y", "e", 0, 40, "+", "a")], "id string, chrom string, start int, end int, strand string, component string")
    edges = spark.createDataFrame([("a", "b", "a", 0.01, False), ("b", "x", "a", 0.02, True), ("x", "y", "a", 0.01, False)], "a string, b string, component string, weight double, overlap boolean")
    found = paralogs.counterparts(edges, nodes, spark.createDataFrame([("a", "a")], "source string, component string"), least=10)
    got = {r.target: (r.chrom, r.start, r.end, r.rel_start, r.rel_end) for r in found.collect()}
    # x ends on an overlap edge; y: b's 50..90 mirrored twice
    assert got == {"b": ("d", 0, 100, 0, 100), "y": ("e", 0, 40, 10, 50)}
    clash = paralogs.conflicts(found, nodes.where("id in ('a', 'y')").select("id"))
    assert [tuple(r) for r in clash.collect()] == [("a", "y")]
    colours = spark.createDataFrame([("a", 0), ("y", 1)], "id string, colour int")
    groups = paralogs.realign_groups(found, colours, nodes)
    regions = paralogs.group_regions(groups, found, nodes).cache()
    assert sorted(r.tag for r in regions.collect()) == ["FC:RG0_0", "NFC:RG0_0", "NFC:RG0_0"]
    own, rest = paralogs.group_beds(regions)
    assert [tuple(r) for r in own.collect()] == [("RG0", "c", "+", 0, 100)]
    assert sorted(tuple(r) for r in rest.collect()) == [("RG0", "d", "-", 0, 100), ("RG0", "e", "+", 0, 40)]


def test_extreme_density_brute_force(spark):
    rng = random.Random(1)
    vectors = [[rng.choice([1] * 12 + [-4, -6, 8]) for _ in range(rng.randint(1, 200))] for _ in range(30)] + [[]]

    def blocks(v, fits):
        return sum(fits(x) and (i == 0 or not fits(v[i - 1])) for i, x in enumerate(v))

    def indel(x):
        return x == -6 or x > 1

    def dense(v, p):
        return [(blocks(w, indel) + blocks(w, lambda x: x == -4)) / (2 * p + 1) for w in (v[max(i - p, 0) : i + p] for i in range(len(v)))]

    def crowds(v, p, least):
        d, i = [x >= least for x in dense(v, p)], 0
        while i < len(d):
            j = i
            while j + 1 < len(d) and d[i] and d[j + 1]:
                j += 1
            if d[i] and blocks(v[max(i - p, 0) : j + p], indel) > 1:
                return True
            i = j + 1
        return False

    df = spark.createDataFrame(list(enumerate(vectors)), "i int, v array<int>")
    for r in df.select("v", sc.densities(F.col("v"), 42).alias("d"), sc.extreme_density(F.col("v")).alias("e")).collect():
        assert all(abs(a - b) < 1e-12 for a, b in zip(r.d, dense(r.v, 42), strict=True))
        assert r.e == (crowds(r.v, 42, 5 / 85) or crowds(r.v, 65, 6 / 131) or any(x >= 12 / 148 for x in dense(r.v, 74)))


def test_read_selections(spark):
    flags = spark.createDataFrame([(3, "c", "c", 300, 0, 60), (3, "c", "d", 300, 0, 60), (1027, "c", "c", 9000, 0, 60), (259, "c", "c", 300, 1, 60)], "flag int, chrom string, mate_chrom string, tlen int, xa int, mapq int")
    assert [r.tlen for r in reads.for_insert_sizes(flags).collect()] == [300]
    assert reads.for_mismatches(flags).count() == 2
    rebased = reads.rebased(spark.createDataFrame([("chr1:100", 5, "q")], "contig string, pos int, qname string"), "RG1").first()
    assert (rebased.chrom, rebased.pos, rebased.qname) == ("chr1", 105, "q:RG1")
    sides = spark.createDataFrame([("c", 1, "A", "C", "0/1"), ("c", 2, "A", "G", "1/1")], "chrom string, pos int, ref string, alt string, gt string")
    other = spark.createDataFrame([("c", 1, "A", "C", "1/1"), ("c", 2, "A", "T", "1/1")], sides.schema)
    assert [variants.members(sides, other, k).count() for k in ("site", "rough", "exact")] == [2, 1, 0]
