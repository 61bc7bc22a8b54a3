"""The composed flows and sequential algorithms against brute force."""

import itertools
import random

import pytest

from lociframe.operators import graphs
from lociframe.plans import flows


def test_best_drops_is_exhaustive():
    rng = random.Random(1)
    for _ in range(150):
        haps = [f"h{i}" for i in range(rng.randint(1, 9))]
        gain = {h: rng.choice([-1.0, 0.5, 1.0, 1.0, 2.5, rng.random() * 3]) for h in haps}
        limits = []
        for _ in range(rng.randint(0, 5)):
            m = frozenset(rng.sample(haps, rng.randint(1, len(haps))))
            limits.append((m, rng.randint(0, len(m))))
        got = graphs.best_drops(gain, limits)
        fits = lambda s: all(len(s & m) <= n for m, n in limits)
        best = max(sum(gain[h] for h in s) for k in range(len(haps) + 1) for s in map(set, itertools.combinations(haps, k)) if fits(s))
        assert fits(got) and abs(sum(gain[h] for h in got) - best) < 1e-9


def test_best_drops_of_many():
    """A chain of windows over 600 haplotypes: no cap, no deep recursion."""
    gain = {f"h{i:03}": 1.0 + (i * 37 % 101) / 100 for i in range(600)}
    names = sorted(gain)
    limits = [(frozenset(names[i : i + 3]), 2) for i in range(0, 600, 3)]
    got = graphs.best_drops(gain, limits)
    assert len(got) == 400 and all(len(got & m) == 2 and min(gain[h] for h in got & m) >= min(gain[h] for h in m) for m, _ in limits)


def by_hand(edges, vertices, cost, apart, most):
    """Colours by all-pairs search over the cheapest (fewest edges, least id) paths."""
    near = {v: {} for v in vertices}
    for a, b, s in edges:
        near[a][b] = near[b][a] = s
    clash = {v: set() for v in vertices}
    for v in vertices:
        level, seen, d = {v: 1.0}, {v}, 0
        while level:
            nxt, d = {}, d + 1
            for u in sorted(level):
                for w in sorted(near[u]):
                    if w not in seen and w not in nxt:
                        nxt[w] = level[u] * near[u][w]
            for w, p in nxt.items():
                if d < apart or (most is not None and p > most):
                    clash[v].add(w)
            seen |= set(nxt)
            level = nxt
    out = {}
    for v in sorted(vertices, key=lambda v: (-cost[v], v)):
        out[v] = next(c for c in itertools.count() if c not in {out[u] for u in out if u in clash[v]})
    return out


@pytest.mark.parametrize(("apart", "most"), [(2, None), (4, None), (2, 0.9), (3, 0.8)])
def test_colours(spark, apart, most):
    rng = random.Random(apart)
    vertices = [f"v{i:02}" for i in range(14)]
    edges = [(a, b, rng.choice([0.7, 0.95, 0.99])) for a, b in itertools.combinations(vertices, 2) if rng.random() < 0.2]
    cost = {v: rng.randint(0, 3) for v in vertices}
    e = spark.createDataFrame([(*x, "c") for x in edges], "a string, b string, similarity double, component string")
    v = spark.createDataFrame([(x, "c", c) for x, c in cost.items()], "id string, component string, cost int")
    got = {r.id: r.colour for r in graphs.colours(e, v, apart, most).collect()}
    assert got == by_hand(edges, vertices, cost, apart, most)


def test_umbrellas(spark):
    rng, rows = random.Random(4), []
    for k in range(160):
        s1, s2 = rng.randint(0, 60), rng.randint(0, 60)
        rows.append((k % 4, "a", s1, s1 + rng.choice([20, 30, 60, 90]), "b", s2, s2 + rng.choice([20, 30, 60, 90]), "+", rng.choice("+-"), rng.choice([3, 3, 5, 9])))
    cols = "target int, chr_1 string, start_1 int, end_1 int, chr_2 string, start_2 int, end_2 int, strand1 string, strand2 string, overlap_len int"
    got = {tuple(r) for r in graphs.drop_umbrellas(spark.createDataFrame(sorted(set(rows)), cols), "target", 0.9).collect()}

    def encloses(x, y):
        side = lambda i: x[i] == y[i] and min(x[i + 2], y[i + 2]) - max(x[i + 1], y[i + 1]) >= 0.9 * (y[i + 2] - y[i + 1])
        return side(1) and side(4) and (x[7] == x[8]) == (y[7] == y[8]) and x[9] <= y[9]

    want = set()
    for t in range(4):
        own = sorted((r for r in set(rows) if r[0] == t), key=lambda r: (-r[9], r[1:9]))
        gone = set()
        for y in own:
            if y not in gone:
                gone |= {x for x in own if x != y and x not in gone and encloses(x, y)}
        want |= set(own) - gone
    assert got == want and len(want) < len(set(rows))


def test_inspect(spark):
    cols = "chunk string, chrom string, start int, end int, hap_id string, hap_depth int, var_count int, indel_count int, similarity double, extreme boolean, scatter boolean"
    window = lambda s, rows: [("c1", "a", s, s + 120, h, d, v, 0, x, e, sc) for h, d, v, x, e, sc in rows]
    one = [("good", 9, 0, 0.0, False, False), ("fine", 8, 1, 0.0, False, False), ("worst", 3, 9, 0.0, False, False), ("wild", 5, 9, 0.0, True, False), ("alike", 5, 3, 6.0, False, False), ("rare", 1, 3, 0.0, False, True), ("rare1", 1, 0, 0.0, False, True)]
    records = window(0, one) + window(120, one[:3]) + [("c2", "a", 900, 1020, "x", 9, 30, 0, 9.0, True, False), ("c2", "a", 900, 1020, "y", 9, 30, 0, 9.0, True, False)]
    haps = [("c1", h[0]) for h in one] + [("c1", "unseen"), ("c2", "x"), ("c2", "y")]
    members = [(c, h, 10 * k + j) for k, (c, h) in enumerate(haps) for j in range(2)]
    got = flows.inspect(spark.createDataFrame(records, cols), spark.createDataFrame(members, "chunk string, hap_id string, qname long")).collect()
    assert len(got) == len(members)
    assert {r.hap_id for r in got if r.mismapped} == {"worst", "wild", "alike", "rare", "rare1"}
    # no window of three or more: the program doesn't run, and scattered names without variants stay
    few = [r for r in records if r[0] == "c1" and r[4] in ("wild", "rare", "rare1")]
    got = flows.inspect(spark.createDataFrame(few, cols), spark.createDataFrame([m for m in members if m[1] in ("wild", "rare", "rare1")], "chunk string, hap_id string, qname long")).collect()
    assert {r.hap_id for r in got if r.mismapped} == {"wild", "rare"}


READS = "chrom string, start int, end int, strand string, mapq int, xa int, tag_as int, tag_xs int, qname long, flag int, id string, cigar string, seq string, quals array<int>"


def aligned(k, chrom, start, seq, cigar, flag=67, mapq=20, xa=1):
    return (chrom, start, start + 60, "+", mapq, xa, 60, 58, k, flag, f"r{k}:{flag}", cigar, seq, [40] * len(seq))


@pytest.fixture(scope="module")
def small(spark):
    """Two copies of a region of 60, ten pairs on it from two haplotypes."""
    plain = "ACGTTGCAAC" * 6
    other = plain[:20] + "T" + plain[21:40] + "A" + plain[41:]
    rows = []
    for k in range(20):
        odd = k % 2
        for flag in (67, 131):
            rows.append(aligned(k, "a", 100, (other if odd else plain), "20=1X19=1X19=" if odd else "60=", flag))
    rows += [aligned(50, "z", 900, plain, "60=", f, 60, 0) for f in (67, 131)]
    pairs = [("a", 90, 170, "b", 500, 580, "+", "+", 2), ("b", 500, 580, "a", 90, 170, "+", "+", 2), ("a", 95, 165, "c", 10, 80, "-", "-", 4), ("z", 900, 990, "y", 1, 90, "+", "-", 3)]
    cols = "chr_1 string, start_1 int, end_1 int, chr_2 string, start_2 int, end_2 int, strand1 string, strand2 string, rate int"
    return spark.createDataFrame(rows, READS), spark.createDataFrame(pairs, cols), spark.createDataFrame([("a", 0, 300, 1), ("z", 0, 2000, 2)], "chrom string, start int, end int, target_id long")


def test_prepare(small):
    made = flows.prepare(*small, least_size=10, least_window=5, scale=0.01)
    assert [(r.chrom, r.start, r.end) for r in made["regions"].collect()] == [("a", 100, 160)]
    tagged = {(r.tag.split(":")[0], r.chrom) for r in made["tagged"].collect()}
    assert {("FC", "a"), ("NFC", "b"), ("NFC", "c")} <= tagged and not {c for _, c in tagged} & {"z", "y"}
    labels = {r.tag.split(":")[1].split("_")[0] for r in made["tagged"].collect()}
    assert {r.label for r in made["groups"].collect()} == labels


def test_eliminate(small):
    from lociframe.operators import phasing

    told = phasing.described(small[0])
    haps = {r.qname: r.hap_id for r in flows.phased(told, 60.0).collect()}
    assert len({haps[k] for k in range(0, 20, 2)}) == 1 and len({haps[k] for k in range(1, 20, 2)}) == 1 and haps[0] != haps[1]
    out = {(r.qname, r.flag): r for r in flows.eliminate(told, small[0], 60.0).collect()}
    assert len(out) == small[0].count() and all(r.kept for r in out.values())  # two haplotypes: all are right


def test_command_line(tmp_path):
    from lociframe.__main__ import main

    with pytest.raises(SystemExit):
        main(["unknown"])


def test_command_line_prepares(spark, small, tmp_path):
    from lociframe.__main__ import main

    for name, df in zip(("reads", "pairs", "targets"), small, strict=True):
        df.write.parquet(str(tmp_path / name))
    paths = [x for n in ("reads", "pairs", "targets", "out") for x in (f"--{n}", str(tmp_path / n))]
    main(["prepare", *paths, "--least-size", "10", "--least-window", "5", "--scale", "0.01"])
    assert spark.read.parquet(str(tmp_path / "out/tagged")).count() == flows.prepare(*small, least_size=10, least_window=5, scale=0.01)["tagged"].count() > 0
    assert spark.read.parquet(str(tmp_path / "out/regions")).count() == 1
