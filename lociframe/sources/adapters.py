"""The star-schema tables as domain tables: reads, targets, pairs, variants.

Each adapter is one SQL text. SPARK and DUCK differ in how days between dates
and integer division are written; everything else is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Length of every contig.
CONTIG = 2600

READS = """
SELECT concat('S', l_suppkey) AS chrom, {days:l_shipdate} AS start, {days:l_shipdate} + CAST(l_quantity AS INT) AS {end},
       CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_linenumber * 10 AS mapq,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS xa,
       CAST(round(l_discount * 100) AS INT) AS tag_as, CAST(round(l_tax * 100) AS INT) AS tag_xs,
       l_orderkey AS qname, CASE WHEN l_linenumber % 2 = 1 THEN 67 ELSE 131 END + CASE WHEN l_linenumber = 7 THEN 1024 ELSE 0 END AS flag,
       l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, CAST(l_quantity AS INT) AS qty
FROM lineitem"""

TARGETS = """
SELECT concat('S', o_custkey % (SELECT count(*) FROM supplier)) AS chrom, {days:o_orderdate} AS start,
       {days:o_orderdate} + 7 + (o_orderkey % 15) AS {end}, o_orderkey AS target_id
FROM orders"""

GENOME = "SELECT concat('S', s_suppkey) AS chrom, 2600 AS length FROM supplier"

#: Two lineitems of an order, ordered by line and part.
SD_PAIRS = """
SELECT DISTINCT a.chrom AS chr_1, a.start AS start_1, a.{end} AS end_1, b.chrom AS chr_2, b.start AS start_2, b.{end} AS end_2,
       a.strand AS strand1, b.strand AS strand2, a.tag_as AS rate
FROM reads a JOIN reads b ON a.qname = b.qname AND (a.ln < b.ln OR (a.ln = b.ln AND a.pk < b.pk))"""

VARIANTS = """
SELECT chrom, pos, ref, alt, min(ac) AS ac, min(an) AS an, min(ad_ref) AS ad_ref, min(ad_alt) AS ad_alt, min(gq) AS gq, min(hp) AS hp, side FROM (
  SELECT chrom, {div:start:7} AS pos, substr('ACGT', CAST(pk % 4 AS INT) + 1, 1) AS ref, substr('ACGT', CAST((pk + 1 + ln % 3) % 4 AS INT) + 1, 1) AS alt,
         qty AS ac, 100 * ln AS an, qty % 9 AS ad_ref, qty % 13 AS ad_alt, tag_as AS gq, ln % 5 AS hp, CASE WHEN tag_xs % 2 = 0 THEN 'q' ELSE 'r' END AS side
  FROM reads) x
GROUP BY chrom, pos, ref, alt, side"""

CIGARS = """
SELECT DISTINCT qname, ln, pk, concat(10 + ln, '=', ln, 'X', 1 + pk % 3, 'I', qty, '=', 1 + sk % 2, 'D', 5, '=') AS cigar FROM reads"""


def _render(sql: str, spark: bool) -> str:
    import re

    day = (lambda m: f"datediff({m[1]}, DATE'1995-01-01')") if spark else (lambda m: f"CAST(date_diff('day', DATE '1995-01-01', CAST({m[1]} AS DATE)) AS INT)")
    div = (lambda m: f"CAST({m[1]} div {m[2]} AS INT)") if spark else (lambda m: f"CAST({m[1]} // {m[2]} AS INT)")
    sql = re.sub(r"\{days:(\w+)\}", day, sql)
    sql = re.sub(r"\{div:([^:}]+):(\w+)\}", div, sql)
    return sql.replace("{end}", "`end`" if spark else '"end"')


TABLES = {"reads": READS, "targets": TARGETS, "genome": GENOME, "sd_pairs": SD_PAIRS, "variants": VARIANTS, "cigars": CIGARS}
SOURCES = ("lineitem", "orders", "supplier")


def pair_rows(reads: DataFrame) -> DataFrame:
    """The rows of SD_PAIRS before DISTINCT, without its join: an order's reads
    are dealt once and meet within its list."""
    packed = reads.where("qname is not null").select("qname", F.struct("chrom", "start", "end", "strand", F.col("tag_as").alias("rate"), "ln", "pk").alias("r"))
    orders = packed.repartition("qname").groupBy("qname").agg(F.collect_list("r").alias("m")).where(F.size("m") > 1)
    each = orders.select("m", F.explode("m").alias("a")).select("a", F.explode("m").alias("b"))
    met = each.where("a.ln < b.ln or (a.ln = b.ln and a.pk < b.pk)")
    sides = [F.col(f"{s}.{c}").alias(f"{n}{i}") for i, s in ((1, "a"), (2, "b")) for c, n in (("chrom", "chr_"), ("start", "start_"), ("end", "end_"))]
    return met.select(*sides, F.col("a.strand").alias("strand1"), F.col("b.strand").alias("strand2"), F.col("a.rate").alias("rate"))


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Adapted tables, lazily; no view outlives the call under a shared name.
    pair_rows is sd_pairs with its repeats, for what doesn't hang on them."""
    import uuid

    tag = uuid.uuid4().hex[:8]
    made: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name not in made:
            if name == "pair_rows":
                made[name] = pair_rows(get("reads"))
            elif name == "sd_pairs":
                made[name] = get("pair_rows").distinct()
            elif name in TABLES:
                sql = _render(TABLES[name], True)
                import re

                for other in {*SOURCES, *TABLES}:
                    if re.search(rf"\b(?:FROM|JOIN) {other}\b", sql):
                        get(other).createOrReplaceTempView(f"{other}_{tag}")
                        sql = re.sub(rf"\b(FROM|JOIN) {other}\b", rf"\1 {other}_{tag}", sql)
                made[name] = spark.sql(sql)
            else:
                made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return made[name]

    return [get(n) for n in names]


def ctes(*names: str) -> str:
    """A WITH list of the adapted tables (and those they need) in DuckDB SQL."""
    order = [n for n in TABLES if n in names or (n == "reads" and {"sd_pairs", "variants", "cigars"} & set(names))]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n != 'genome' else ''}({_render(TABLES[n], False)})" for n in order)
