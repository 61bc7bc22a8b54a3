"""The corpus pipeline's stages, each against brute force on a small fixture."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lociframe.llm.common import vocabulary

from .test_operators import BASE, edited, prose, shingles, whole_ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", score double, predicted int, __text string, id string, __key string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, rows, labels = random.Random(2), [], []
    for k in range(500):
        words = prose(rng.randint(5, 120), 40_000 + k).split()
        bad = k % 4 == 0
        for _ in range(3 * bad):
            words[rng.randrange(len(words))] = rng.choice(["nastyword", "vileword", "foulwords"])
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    items = [(k, prose(n, 60_000 + k)) for k, n in enumerate((15, 40, 90))]
    rows += [(600, BASE), (601, BASE), (602, edited(BASE, 1, 3)), (602, prose(50, 9)), (603, None), (604, ""), (None, "no id"), (605, prose(20, 7) + " " + items[1][1] + " tail"), (606, items[0][1])]
    where = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 0.9, 1, "kept", "i", "k") for d, t in rows], SCHEMA + EXTRA)
    docs.repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), rows, items


def found(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_toxicity_stage(spark, tables):
    where, rows, _ = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    left = corpus_pipeline.toxicity_stage(spark, docs, where)
    assert left.columns == docs.columns and {(r["score"], r["predicted"], r["__text"]) for r in left.collect()} == {(0.9, 1, "kept")}
    have = {d for d, _ in found(left)}
    bad = {d for d, t in rows if t and ("nastyword" in t or "vileword" in t or "foulwords" in t)}
    assert len(bad & have) < 0.05 * len(bad) and len([d for d, _ in rows if d not in bad and d not in have]) < 0.05 * len(rows)
    assert corpus_pipeline.toxicity_stage(spark, docs.limit(0), where).count() == 0


def test_near_dup_stage(spark, tables):
    where, rows, _ = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    left = corpus_pipeline.near_dup_stage(spark, docs, where)
    assert left.columns == docs.columns
    # brute force: groups of rows, of which the first by id stays
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        union = len(sets[a] | sets[b])
        if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * union:
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
    first = {}
    for k, g in enumerate(group):
        if g not in first or rows[k][0] < rows[first[g]][0]:
            first[g] = k
    assert found(left) == sorted((rows[k] for k in first.values()), key=str)


def test_decontamination_stage(spark, tables):
    where, rows, _ = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    left = corpus_pipeline.decontamination_stage(spark, docs, where)
    assert left.columns == docs.columns and found(left) == sorted((r for r in rows if r[0] not in (605, 606)), key=str)


def test_packing_stage_and_run(spark, tables):
    where, rows, _ = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    got = corpus_pipeline.packing_stage(spark, docs.drop("id"), where).toPandas()
    assert got.length.sum() == sum(len(whole_ids(t)) for _, t in rows) and got.groupby("sequence_id").length.sum().max() <= 4096
    # run() is the stages one after the other
    step = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        step = stage(spark, step, where)
    want = sorted(len(whole_ids(t)) for _, t in found(step))
    out = corpus_pipeline.run(spark, where)
    assert sorted(r["sum"] for r in out.groupBy(F.coalesce("doc_id", F.lit(-1)), "piece", "ids_crc32").agg(F.sum("length").alias("sum")).collect()) == want
    assert vocabulary()
