"""Steps that must grow no faster than their input: same results as brute
force, and plans that deal each row few times."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lociframe.functions import scalars as sc
from lociframe.operators import graphs, intervals, reads
from lociframe.plans import catalogue
from lociframe.sources import adapters

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pair_rows_are_the_pairs(spark):
    rows = [(1, "a", 5, 9, "+", 3, 1, 7), (1, "b", 6, 9, "-", 4, 1, 8), (1, "b", 6, 9, "-", 4, 2, 8), (1, "b", 6, 9, "-", 4, 2, 8), (2, "c", 0, 3, "+", 1, 1, 1), (None, "c", 0, 3, "+", 1, 1, 1), (None, "d", 0, 3, "+", 1, 2, 1), (3, "c", None, None, "+", None, None, 1), (3, "c", 1, 2, "+", None, 1, 1)]
    r = spark.createDataFrame(rows, "qname long, chrom string, start int, end int, strand string, tag_as int, ln int, pk long")
    want = [(*x[1:4], *y[1:4], x[4], y[4], x[5]) for x, y in itertools.permutations(rows, 2) if x[0] is not None and x[0] == y[0] and x[6] is not None and y[6] is not None and (x[6], x[7]) < (y[6], y[7])]
    got = adapters.pair_rows(r)
    assert got.columns == ["chr_1", "start_1", "end_1", "chr_2", "start_2", "end_2", "strand1", "strand2", "rate"]
    assert plan(got).count("Exchange hash") == 1
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("forest", [1, 5, 1000])
def test_components_of_many_forests(spark, monkeypatch, forest):
    monkeypatch.setattr(graphs, "FOREST", forest)
    rng = random.Random(forest)
    for kind, name in (("string", "v{}"), ("long", None)):
        edges = [(a, b) if name is None else (name.format(a), name.format(b)) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(170))]
        left = {v: v for e in edges for v in e if e[0] != e[1]}
        for _ in left:
            for a, b in edges:
                if a != b:
                    left[a] = left[b] = min(left[a], left[b])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        got = graphs.components(spark.createDataFrame([*edges, (None, edges[0][0])], f"a {kind}, b {kind}").repartition(5)).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {r.id: r.component for r in got} == left and len(got) == len(left)


def test_small_groups_share_a_task(spark):
    a = spark.createDataFrame([(k, 10**17 + k, None if k % 2 else 0.5) for k in range(50)] * 2 + [(None, 1, 1.0)], "k long, x long, w double")
    b = spark.createDataFrame([(k, str(k)) for k in range(40, 60)], "k long, t string")
    got = graphs.grouped(lambda k, mine, own: [(k, sum(x for x, _ in mine), len(mine), ",".join(t for (t,) in own))], "k long, s long, n int, t string", "k", a, b)
    want = [(k, 2 * (10**17 + k) * (k < 50), 2 * (k < 50), str(k) * (k >= 40)) for k in range(60)] + [(None, 1, 1, "")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    for name in ("coloring", "counterparts", "shortest_paths"):
        assert "FlatMapCoGroups" not in plan(catalogue.QUERIES[name](spark, SF))
    assert a.where(F.col("k") < 0).count() == 0


PAIR = "chr_1 string, start_1 int, end_1 int, chr_2 string, start_2 int, end_2 int, strand1 string, strand2 string"


def some_pairs(rng, n):
    place = lambda: (rng.choice("cd"), *sorted(rng.sample(range(12), 2)))
    return [(*place(), *place(), rng.choice("+-"), rng.choice("+-")) for _ in range(n)]


def test_repeats_and_first_of_unordered(spark):
    rng = random.Random(4)
    rows = [(*p, rng.randint(0, 3)) for p in some_pairs(rng, 60)]
    rows += [(*p[3:6], *p[:3], p[7], p[6], 1) for p in rows[:30]] + rows[:10]
    df = spark.createDataFrame(rows, f"{PAIR}, rate int")
    whole = set(rows)
    alike = lambda x, y: (x[6] == x[7]) == (y[6] == y[7]) and y[:6] in (x[:6], x[3:6] + x[:3])
    got = graphs.repeats(df)
    assert plan(got).count("Exchange hash") == 1
    assert sorted(map(tuple, got.collect())) == sorted((*x, sum(alike(x, y) for y in whole)) for x in whole)
    first = {}
    for *p, rate in rows:
        x, y = (":".join(map(str, (*p[i : i + 3], p[6 + i // 3]))) for i in (0, 3))
        first[frozenset((x, y))] = min(first.get(frozenset((x, y)), (x, y, rate)), (x, y, rate))
    assert sorted(map(tuple, reads.first_of_unordered(graphs.links(df, "rate")).collect())) == sorted(first.values())


def test_umbrella_counts(spark):
    rng = random.Random(5)
    rows = [(g, *p, rng.randint(1, 4)) for g in range(4) for p in set(some_pairs(rng, 25))]
    df = spark.createDataFrame(rows, f"g int, {PAIR}, overlap_len int")

    def around(x, y):
        share = lambda i: x[i] == y[i] and min(x[i + 2], y[i + 2]) - max(x[i + 1], y[i + 1]) >= 0.5 * (y[i + 2] - y[i + 1])
        return x[0] == y[0] and share(1) and share(4) and (x[7] == x[8]) == (y[7] == y[8]) and x[9] <= y[9]

    want = {g: sum(around(x, y) for x in rows for y in rows if x[0] == g) for g in range(4)}
    assert {r.g: r.n for r in graphs.umbrella_counts(df, "g", 0.5).collect()} == want


def test_lift_pairs_as_lift_relative(spark):
    rng = random.Random(6)
    rows = sorted(set(some_pairs(rng, 40)))
    targets = spark.createDataFrame([(rng.choice("cd"), s, s + rng.randint(1, 3)) for s in (rng.randint(0, 11) for _ in range(12))], "chrom string, start int, end int")
    sides = [spark.createDataFrame([(k, *r[i : i + 3], r[6 + i // 3]) for k, r in enumerate(rows)], "group int, chrom string, start int, end int, strand string") for i in (0, 3)]
    want = sorted((r.chrom, r.start, r.end, *rows[r.group]) for r in intervals.lift_relative(*sides, targets, 1).collect())
    got = intervals.lift_pairs(spark.createDataFrame(rows * 2, PAIR), targets, 1).collect()
    assert want and sorted((r.chr_2, r.start, r.end, *tuple(r)[:8]) for r in got) == want


def test_densities_of_batches(spark):
    rng = random.Random(7)
    vectors = [None, [], [-4], *[[rng.choice([1] * 6 + [-4, -6, 8]) for _ in range(rng.randint(1, 40))] for _ in range(30)]]
    fits = (lambda v: v == -4, lambda v: v == -6 or v > 1)

    def brute(v, p):
        opened = lambda f, i, low: f(v[i]) and (i == low or not f(v[i - 1]))
        return [sum(opened(f, j, max(i - p, 0)) for f in fits for j in range(max(i - p, 0), min(i + p, len(v)))) / (2 * p + 1) for i in range(len(v))]

    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "k int, v array<int>")
    for p in (3, 42):
        got = dict(df.select("k", sc.densities(F.col("v"), p)).collect())
        assert got == {k: brute(v or [], p) for k, v in enumerate(vectors)}
    assert "ArrowEvalPython" in plan(df.select(sc.extreme_density(F.col("v"))))
