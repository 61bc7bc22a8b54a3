"""Sweeps over tiles give what one sweep over a chrom gives."""

import random

import pytest
from pyspark.sql import functions as F

from lociframe.operators import intervals


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(3), []
    for k in range(400):
        start = rng.randint(0, 3000)
        out.append((rng.choice(["a", "b", None]), start, start + rng.choice([1, 5, 20, 20, 300, 900 if k % 50 == 0 else 2])))
    return out, spark.createDataFrame(out, "chrom string, start int, end int")


def swept(rows, gap):
    """(chrom, start, end) -> island, by one pass."""
    got = {}
    for chrom in {r[0] for r in rows}:
        reach, n = None, 0
        for _, s, e in sorted((r for r in rows if r[0] == chrom), key=lambda r: r[1:]):
            if reach is None or s > reach + gap:
                n += 1
            reach = e if reach is None else max(reach, e)
            got[chrom, s, e] = n
    return got


@pytest.mark.parametrize("tile", [7, 64, 1000, 1 << 16])
@pytest.mark.parametrize("gap", [0, 25])
def test_islands(rows, tile, gap):
    got = {(r.chrom, r.start, r.end): r.island for r in intervals.islands(rows[1], gap, tile=tile).collect()}
    assert got == swept(rows[0], gap)


@pytest.mark.parametrize("tile", [7, 64, 1 << 16])
def test_depth_and_contained(rows, tile):
    some = rows[1].where("chrom is not null")
    want = {}
    for c, s, e in rows[0]:
        for p in range(s, e) if c else ():
            want[c, p] = want.get((c, p), 0) + 1
    got = {}
    for r in intervals.depth_runs(some, tile, wide=F.col("end") - F.col("start") > 10).collect():
        assert r.wide <= r.depth
        for p in range(r.start, r.end):
            assert (r.chrom, p) not in got
            got[r.chrom, p] = r.depth
    assert got == want
    kept = {(r.chrom, r.start, r.end) for r in intervals.drop_contained(some.distinct(), tile).collect()}
    every = {r for r in rows[0] if r[0]}
    assert kept == {x for x in every if not any(y != x and y[0] == x[0] and y[1] <= x[1] and y[2] >= x[2] for y in every)}


def test_subtract_keeps_equal_rows(spark):
    a = spark.createDataFrame([("a", "+", 0, 10)] * 3, "chrom string, strand string, start int, end int")
    b = spark.createDataFrame([("a", "+", 4, 6), ("a", "-", 0, 10)], "chrom string, strand string, start int, end int")
    got = sorted((r.start, r.end) for r in intervals.subtract(a, b).collect())
    assert got == [(0, 4)] * 3 + [(6, 10)] * 3
