"""Registered queries over the adapted tables, each with its DuckDB SQL.

A query is registered with its result columns and their kinds: s text, i long,
d double (rounded to 6 places), b boolean; both engines' results are brought to
these. Queries without SQL are sequential algorithms, tested by brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import graphs, intervals, paralogs, phasing, reads, variants
from ..sources import adapters
from . import flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KINDS = {"s": ("string", "VARCHAR"), "i": ("bigint", "BIGINT"), "d": ("double", "DOUBLE"), "b": ("boolean", "BOOLEAN")}


def query(name: str, columns: str, tables: str, sql: str | None = None, given: str | None = None):
    """Registers a function of the named tables; sql follows their WITH list.
    given: the tables that the function takes in their place (the same rows, or
    pair_rows for sd_pairs where repeats don't matter)."""
    spec = [c.split(":") for c in columns.split()]

    def wrap(make: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = make(*adapters.load(spark, sf_dir, *(given or tables).split()))
            out = [F.round(F.col(c).cast("double"), 6) + F.lit(0.0) if k == "d" else F.col(c).cast(KINDS[k][0]) for c, k in spec]
            return df.select(*[x.alias(c) for x, (c, _) in zip(out, spec, strict=True)])

        run.__doc__ = make.__doc__
        QUERIES[name] = run
        if sql:
            cast = ", ".join(f'round(CAST("{c}" AS DOUBLE), 6) + 0.0 AS "{c}"' if k == "d" else f'CAST("{c}" AS {KINDS[k][1]}) AS "{c}"' for c, k in spec)
            head = adapters.ctes(*tables.split())
            parts = sql.strip()
            body, lead = (parts[4:], True) if parts[:4] == "WITH" else (parts, False)
            if lead:
                depth, cut = 0, 0
                for i, ch in enumerate(body):
                    depth += (ch == "(") - (ch == ")")
                    if depth == 0 and body[i : i + 7] == "SELECT " and body[:i].rstrip().endswith(")"):
                        cut = i
                        break
                extra, final = body[:cut], body[cut:]
                ORACLES[name] = f"{head},\n{extra}SELECT {cast} FROM ({final}) z_"
            else:
                ORACLES[name] = f"{head}\nSELECT {cast} FROM ({body}) z_"
        return run

    return wrap


IV = "chrom:s start:i end:i"
#: SQL of merged intervals of table t (keys k, gap g).
MERGE = """SELECT {k}, min(start) AS start, max("end") AS "end" FROM (
  SELECT *, sum(o) OVER (PARTITION BY {k} ORDER BY start, "end" RANGE UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY {k} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {g} THEN 0 ELSE 1 END AS o FROM {t}) a) b
GROUP BY {k}, g"""
DEPTH = """SELECT * FROM (
  SELECT chrom, pos AS start, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS "end",
         sum(d) OVER w AS depth, sum(h) OVER w AS high, sum(x) OVER w AS multi, sum(s) OVER w AS near
  FROM (SELECT chrom, pos, sum(d) AS d, sum(h) AS h, sum(x) AS x, sum(s) AS s FROM (
      SELECT chrom, start AS pos, 1 AS d, CASE WHEN mapq >= 41 THEN 1 ELSE 0 END AS h, xa AS x, CASE WHEN tag_as - tag_xs <= 5 THEN 1 ELSE 0 END AS s FROM reads
      UNION ALL
      SELECT chrom, "end", -1, CASE WHEN mapq >= 41 THEN -1 ELSE 0 END, -xa, CASE WHEN tag_as - tag_xs <= 5 THEN -1 ELSE 0 END FROM reads) e GROUP BY chrom, pos) p
  WINDOW w AS (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING)) q WHERE "end" IS NOT NULL AND depth > 0"""


# --- pipelines over depth ---------------------------------------------------------
MULTI_SQL = f"""WITH dep AS ({DEPTH}),
kept AS (SELECT chrom, start, "end" FROM dep WHERE depth >= 5 AND (multi >= 0.5 * depth OR near >= 0.5 * depth) AND high <= 10),
m AS ({MERGE.format(k="chrom", g=0, t="kept")}),
t AS ({MERGE.format(k="chrom", g=0, t="targets")})
SELECT m.chrom, greatest(m.start, t.start) AS start, least(m."end", t."end") AS "end" FROM m JOIN t ON m.chrom = t.chrom AND m.start < t."end" AND t.start < m."end" """
query("multialign_regions", IV, "reads targets", MULTI_SQL)(flows.multialigned)

query("iv_merge", IV, "reads", MERGE.format(k="chrom", g=0, t="reads"))(lambda r: intervals.merge(r))
query("iv_merge_d", IV, "targets", MERGE.format(k="chrom", g=40, t="targets"))(lambda t: intervals.merge(t, 40))
query("iv_merge_s", "chrom:s strand:s start:i end:i names:s", "reads", MERGE.format(k="chrom, strand", g=0, t="reads").replace("SELECT chrom, strand,", "SELECT chrom, strand, string_agg(DISTINCT CAST(mapq AS VARCHAR), ',' ORDER BY CAST(mapq AS VARCHAR)) AS names,", 1))(
    lambda r: intervals.merge_stranded(r, distinct=("mapq",)).withColumnRenamed("mapq", "names"))
HIT = 'reads a JOIN targets b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end"'
query("iv_intersect", IV, "reads targets", f'SELECT a.chrom, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end" FROM {HIT}')(lambda r, t: intervals.intersect(r, t))
query("iv_intersect_wo", "chrom:s start:i end:i start_b:i end_b:i overlap_len:i", "reads targets", f'SELECT a.chrom, a.start, a."end", b.start AS start_b, b."end" AS end_b, least(a."end", b."end") - greatest(a.start, b.start) AS overlap_len FROM {HIT}')(
    lambda r, t: intervals.overlaps(r, t))
query("iv_intersect_wao", "chrom:s start:i end:i start_b:i end_b:i overlap_len:i", "targets reads",
      'SELECT a.chrom, a.start, a."end", b.start AS start_b, b."end" AS end_b, CASE WHEN b.start IS NULL THEN 0 ELSE least(a."end", b."end") - greatest(a.start, b.start) END AS overlap_len FROM targets a LEFT JOIN reads b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end"')(
    lambda t, r: intervals.overlaps(t, r.select("chrom", "start", "end"), how="left"))
query("iv_subtract_s", "chrom:s strand:s start:i end:i", "reads targets", f"""WITH cut AS (SELECT chrom, strand, start, "end" FROM reads WHERE mapq >= 50),
h AS ({MERGE.format(k="chrom, strand", g=0, t="cut")}),
own AS (SELECT DISTINCT chrom, strand, start, "end" FROM reads WHERE mapq < 20),
b AS (SELECT own.*, unnest(generate_series(own.start, own."end" - 1)) AS p FROM own),
u AS (SELECT b.* FROM b LEFT JOIN h ON h.chrom = b.chrom AND h.strand = b.strand AND h.start <= b.p AND b.p < h."end" WHERE h.chrom IS NULL),
g AS (SELECT *, p - row_number() OVER (PARTITION BY chrom, strand, start, "end" ORDER BY p) AS k FROM u)
SELECT chrom, strand, min(p) AS start, max(p) + 1 AS "end" FROM g GROUP BY chrom, strand, g.start, g."end", k""")(
    lambda r, t: intervals.subtract(r.where("mapq < 20").select("chrom", "strand", "start", "end").distinct(), r.where("mapq >= 50").select("chrom", "strand", "start", "end")))
query("iv_slop", IV, "targets genome", 'SELECT t.chrom, greatest(0, start - 100) AS start, least(length, "end" + 100) AS "end" FROM targets t JOIN genome g ON g.chrom = t.chrom')(lambda t, g: intervals.slop(t, g, 100))
query("iv_total_coverage", "covered:i", "reads", f"""WITH m AS ({MERGE.format(k="chrom", g=0, t="reads")}) SELECT sum("end" - start) AS covered FROM m""")(lambda r: intervals.total_coverage(r))
query("iv_genomecov", "chrom:s start:i end:i depth:i", "reads", f'SELECT chrom, start, "end", depth FROM ({DEPTH}) d')(lambda r: intervals.depth_runs(r))
query("iv_depth", "chrom:s pos:i depth:i", "reads", f'SELECT chrom, unnest(generate_series(start + 1, "end")) AS pos, depth FROM ({DEPTH}) d')(lambda r: intervals.per_base(intervals.depth_runs(r)))
BLOCKS = f"""blk AS (SELECT chrom, start, "end" FROM ({DEPTH}) d WHERE depth >= {{k}}), mrg AS ({MERGE.format(k="chrom", g=0, t="blk")})"""
query("iv_depth_blocks", IV, "reads", f'WITH {BLOCKS.format(k=3)} SELECT chrom, start + 1 AS start, "end" + 1 AS "end" FROM mrg')(lambda r: intervals.depth_blocks(intervals.depth_runs(r), 3))
query("iv_windows", IV, "reads", f'WITH {BLOCKS.format(k=5)} SELECT chrom, w AS start, least(w + 120, "end") AS "end" FROM (SELECT chrom, "end", unnest(generate_series(start, "end" - 1, 30)) AS w FROM mrg) x')(
    lambda r: intervals.windows(intervals.depth_blocks(intervals.depth_runs(r), 5, one_based=False), 120, 30))
query("iv_contained", IV, "reads", """SELECT chrom, start, "end" FROM (SELECT DISTINCT chrom, start, "end", max("end") OVER (PARTITION BY chrom ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT DISTINCT chrom, start, "end" FROM reads) d) x WHERE m IS NULL OR "end" > m""")(
    lambda r: intervals.drop_contained(r.select("chrom", "start", "end").distinct()))
query("iv_cont_regions", "chrom:s island:i n:i start:i end:i", "reads", """SELECT chrom, g AS island, count(*) AS n, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY start, "end" RANGE UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM reads) a) b GROUP BY chrom, g""")(
    lambda r: intervals.islands(r).groupBy("chrom", "island").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end")))
query("iv_concat", "chrom:s start:i end:i", "reads targets", 'SELECT chrom, start, "end" FROM reads UNION ALL SELECT chrom, start, "end" FROM targets')(lambda r, t: r.select("chrom", "start", "end").unionByName(t.select("chrom", "start", "end")))
LIFT_A, LIFT_B = "greatest(t0, start_1) - start_1", "least(t1, end_1) - start_1"
query("iv_lift", "chr_2:s lift_start:i lift_end:i", "sd_pairs", f"""SELECT chr_2, lift_start, lift_end FROM (SELECT chr_2,
  greatest(start_2, CASE WHEN strand1 = strand2 THEN start_2 + {LIFT_A} ELSE end_2 - ({LIFT_B}) END) AS lift_start,
  least(end_2, CASE WHEN strand1 = strand2 THEN start_2 + {LIFT_B} ELSE end_2 - ({LIFT_A}) END) AS lift_end
  FROM (SELECT *, start_1 + 2 AS t0, end_1 - 3 AS t1 FROM sd_pairs) p) q WHERE lift_start < lift_end""")(
    lambda p: intervals.lift(p.withColumns({"target_start": F.col("start_1") + 2, "target_end": F.col("end_1") - 3})))
query("iv_rebase", "chrom:s pos:i qname:s", "reads", "SELECT split_part(c, ':', 1) AS chrom, CAST(split_part(c, ':', 2) AS BIGINT) + p AS pos, qname || ':RG1' AS qname FROM (SELECT chrom || ':' || (start - start % 100) AS c, start % 100 AS p, qname FROM reads) x")(
    lambda r: r.select(F.concat_ws(":", "chrom", (F.col("start") - F.col("start") % 100).cast("string")).alias("c"), (F.col("start") % 100).alias("p"), "qname").select(F.split("c", ":")[0].alias("chrom"), (F.split("c", ":")[1].cast("long") + F.col("p")).alias("pos"), F.concat(F.col("qname").cast("string"), F.lit(":RG1")).alias("qname")))
query("iv_mask", "qname:s masked:s", "reads", "SELECT qname, CASE WHEN length(s) <= 10 THEN repeat('N', CAST(length(s) AS BIGINT)) ELSE repeat('N', 5) || substr(s, 6, length(s) - 10) || repeat('N', 5) END AS masked FROM (SELECT qname, repeat('ACGT', CAST(qty AS BIGINT)) AS s FROM reads) x")(
    lambda r: r.select(F.col("qname").cast("string").alias("qname"), sc.masked(F.repeat(F.lit("ACGT"), F.col("qty")), 5).alias("masked")))
query("iv_target_split", IV, "targets reads genome", f"""WITH {BLOCKS.format(k=3)},
bl AS (SELECT chrom, start + 1 AS start, "end" + 1 AS "end" FROM mrg),
mt AS ({MERGE.format(k="chrom", g=20, t="targets")})
SELECT chrom, start, "end" FROM mt WHERE "end" - start BETWEEN 30 AND 60
UNION ALL SELECT a.chrom, greatest(a.start, b.start), least(a."end", b."end") FROM mt a JOIN bl b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" WHERE a."end" - a.start > 60
UNION ALL SELECT a.chrom, CASE WHEN b.start IS NULL THEN a.start - 10 WHEN b."end" - b.start <= 60 THEN b.start ELSE greatest(0, a.start - 10) END,
  CASE WHEN b.start IS NULL THEN a."end" + 10 WHEN b."end" - b.start <= 60 THEN b."end" ELSE least(2600, a."end" + 10) END
FROM mt a LEFT JOIN bl b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" WHERE a."end" - a.start < 30""")(
    lambda t, r, g: intervals.target_split(t, intervals.depth_blocks(intervals.depth_runs(r), 3), g, 10, 30, 60))
query("overlap_pairs", "chrom:s start:i a:i b:i overlap_len:i", "reads", """WITH d AS (SELECT DISTINCT chrom, start, "end", qname FROM reads WHERE mapq >= 60) SELECT a.chrom, greatest(a.start, b.start) AS start, a.qname AS a, b.qname AS b, least(a."end", b."end") - greatest(a.start, b.start) AS overlap_len
FROM d a JOIN d b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" AND a.qname < b.qname""")(
    lambda r: (lambda d: intervals.overlaps(d, d).where("qname < qname_b").select("chrom", F.greatest("start", "start_b").alias("start"), F.col("qname").alias("a"), F.col("qname_b").alias("b"), "overlap_len"))(r.where("mapq >= 60").select("chrom", "start", "end", "qname").distinct()))

# --- reads --------------------------------------------------------------------------
OK = "mapq >= 20 AND (flag & 3844) = 0"
XS = "coalesce(tag_as - tag_xs <= 5, tag_xs IS NOT NULL)"
READ = "chrom:s start:i end:i qname:i mapq:i"
for _logic, _sql in (("and", f"xa = 1 AND {XS}"), ("or", f"(xa = 1 OR {XS})"), ("not", f"NOT (xa = 1 OR {XS})")):
    query(f"read_filter_{_logic}", READ, "reads", f'SELECT chrom, start, "end", qname, mapq FROM reads WHERE {OK} AND {_sql}')(lambda r, k=_logic: reads.read_filter(r, 20, ("xa", "xs"), k))
query("noisy_pairs", "qname:i chrom:s start:i end:i", "reads", """WITH x AS (SELECT *, CASE WHEN (flag & 2304) <> 0 THEN false WHEN (flag & 516) <> 0 OR mapq < 20 THEN true WHEN (flag & 1) <> 0 AND ("end" - start) * 10 < 75 THEN true ELSE false END AS noisy FROM reads),
ok AS (SELECT qname FROM x GROUP BY qname HAVING NOT bool_or(noisy) AND bool_or((flag & 64) <> 0) AND bool_or((flag & 128) <> 0))
SELECT qname, chrom, min(start) AS start, max("end") AS "end" FROM x WHERE qname IN (SELECT qname FROM ok) GROUP BY qname, chrom""")(
    lambda r: reads.clean_pairs(r.withColumn("noisy", reads.noisy(F.col("flag"), F.col("mapq"), (F.col("end") - F.col("start")) * 10, F.lit(False), least_mapq=20))))
for _name, _where, _multi in (("recruit_fc", "true", False), ("recruit_nfc", "(a.xa = 1 OR a.mapq < 50)", True)):
    query(_name, READ, "reads targets", f'SELECT chrom, start, "end", qname, mapq FROM reads WHERE qname IN (SELECT a.qname FROM {HIT} WHERE {_where})')(lambda r, t, m=_multi: reads.recruit(r, t, m))
query("insert_stats", "mean:d median:d deviation:d n:i", "reads", 'WITH s AS (SELECT "end" - start AS size FROM reads), k AS (SELECT size FROM s WHERE size <= (SELECT quantile_cont(size, 0.99) FROM s)) SELECT avg(size) AS mean, median(size) AS median, stddev_pop(size) AS deviation, count(*) AS n FROM k')(
    lambda r: reads.insert_statistics(r.select((F.col("end") - F.col("start")).alias("size"))))
query("nm_poisson", "chrom:s rate:d k:i", "reads", """WITH m AS (SELECT chrom, avg(tag_as) AS rate FROM reads GROUP BY chrom),
c AS (SELECT chrom, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY chrom ORDER BY k ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT chrom, rate, unnest(generate_series(0, 60)) AS k FROM m) x)
SELECT chrom, rate, min(k) AS k FROM c WHERE s >= 0.95 GROUP BY chrom, rate""")(
    lambda r: r.groupBy("chrom").agg(F.avg("tag_as").alias("rate")).withColumn("k", sc.poisson_quantile(F.col("rate"), 0.95, 60)))
query("dedup_mark", "chrom:s start:i strand:s qname:i", "reads", """SELECT chrom, start, strand, qname FROM (SELECT *, row_number() OVER (PARTITION BY chrom, start, strand ORDER BY mapq DESC, qname, pk, ln, qty) AS n FROM reads) x WHERE n = 1""")(
    lambda r: reads.first_of_duplicates(r, ["chrom", "start", "strand"], [F.col("mapq").desc(), F.col("qname"), F.col("pk"), F.col("ln"), F.col("qty")]))

# --- text, CIGAR and vectors ------------------------------------------------------------
query("region_fmt_parse", "region:s padded:s chrom:s start:i", "reads", """SELECT chrom || ':' || start || '-' || "end" || ':' || strand AS region, chrom || ':' || (start - 1000) || '-' || ("end" + 1000) AS padded, chrom, start FROM reads""")(
    lambda r: r.select(sc.region_text(F.col("chrom"), F.col("start"), F.col("end"), F.col("strand")).alias("region")).select("region", sc.pad_region(F.col("region"), 1000).alias("padded"), sc.parse_region(F.col("region")).alias("p")).select("region", "padded", "p.chrom", "p.start"))
NA_VALUES = ("NA", "NaN,NA", "", ".", "-* _", "x", "NA1", "0", "nan;nan")
query("na_value", "i:i na:b", "reads", f"""SELECT ln AS i, regexp_matches(v, '^((NA|NaN|nan)([,;|&/](NA|NaN|nan))*|[.*_ -]*)$') AS na FROM (SELECT ln, list_value({", ".join(repr(x) for x in NA_VALUES)})[CAST(ln + 1 AS BIGINT)] AS v FROM reads) x""")(
    lambda r: r.select(F.col("ln").alias("i"), sc.is_na(F.element_at(F.array(*[F.lit(x) for x in NA_VALUES]), F.col("ln") + 1)).alias("na")))
query("revcomp", "qname:i seq:s", "reads", "SELECT qname, reverse(translate(substr('ACGTTGCAAC', ln, 4), 'ACGTacgt', 'TGCAtgca')) AS seq FROM reads")(lambda r: r.select("qname", sc.reverse_complement(F.lit("ACGTTGCAAC").substr(F.col("ln"), F.lit(4))).alias("seq")))
CIG = "regexp_extract_all(cigar, '(\\d+)[=XID]', 1)"
SUMS = lambda ops: "(" + " + ".join(f"coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+){o}', 1), lambda x: CAST(x AS INT))), 0)" for o in ops) + ")"
query("cigar_stats", "qname:i ln:i pk:i ref_len:i identity:d gap:i", "cigars", f"""SELECT qname, ln, pk, {SUMS("=XD")} AS ref_len, round({SUMS("=")} * 1.0 / {SUMS("=XID")}, 4) AS identity,
greatest(CASE WHEN {SUMS("I")} > 1 THEN {SUMS("I")} ELSE 0 END, CASE WHEN {SUMS("D")} > 1 THEN {SUMS("D")} ELSE 0 END) AS gap FROM cigars""")(
    lambda c: c.withColumn("ops", sc.cigar_ops(F.col("cigar"))).select("qname", "ln", "pk", sc.reference_length(F.col("ops")).alias("ref_len"), sc.identity(F.col("ops")).alias("identity"), sc.longest_gap(F.col("ops")).alias("gap")))
VEC = """WITH n AS (SELECT *, list_transform(regexp_extract_all(cigar, '(\\d+)[=XID]', 1), lambda x: CAST(x AS INT)) AS v FROM cigars)"""
query("hapvec", "qname:i ln:i pk:i n:i total:i", "cigars", VEC + " SELECT qname, ln, pk, v[1] + v[2] + v[4] + v[5] + v[6] AS n, v[1] - 4 * v[2] + v[4] - 1 + 4 * v[3] - 6 * v[5] + v[6] AS total FROM n")(
    lambda c: c.select("qname", "ln", "pk", sc.read_vector(sc.cigar_ops(F.col("cigar"))).alias("v")).select("qname", "ln", "pk", F.size("v").alias("n"), F.aggregate("v", F.lit(0), lambda a, x: a + x).alias("total")))
query("errvec", "qname:i ln:i pk:i n:i total:d", "cigars", VEC + " SELECT qname, ln, pk, v[1] + v[2] + v[4] + v[5] + v[6] AS n, (v[1] + v[2] - 1 + v[4] + v[6]) * 0.01 AS total FROM n")(
    lambda c: c.select("qname", "ln", "pk", sc.error_vector(sc.cigar_ops(F.col("cigar")), F.array_repeat(F.lit(20), 400)).alias("v")).select("qname", "ln", "pk", F.size("v").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total")))
query("refqidx", "qname:i ln:i pk:i n:i gaps:i last:i", "cigars", VEC + " SELECT qname, ln, pk, v[1] + v[2] + v[4] + v[5] + v[6] AS n, v[5] AS gaps, v[1] + v[2] + v[3] + v[4] + v[6] - 1 AS last FROM n")(
    lambda c: c.select("qname", "ln", "pk", sc.query_index(sc.cigar_ops(F.col("cigar"))).alias("v")).select("qname", "ln", "pk", F.size("v").alias("n"), F.size(F.filter("v", lambda x: x == -1)).alias("gaps"), F.array_max("v").alias("last")))
query("block_counts", "qname:i ln:i pk:i snv:i indel:i", "cigars", VEC + " SELECT qname, ln, pk, 1 AS snv, CASE WHEN v[4] = 1 THEN 1 ELSE 2 END AS indel FROM n")(
    lambda c: c.select("qname", "ln", "pk", sc.read_vector(sc.cigar_ops(F.col("cigar"))).alias("v")).select("qname", "ln", "pk", sc.count_snv(F.col("v")).alias("snv"), sc.count_indel(F.col("v")).alias("indel")))
query("similarity_score", "qname:i ln:i pk:i score:d", "cigars", "SELECT qname, ln, pk, (ln + 3 - pk % 4) + CASE WHEN pk % 4 > 0 THEN (ln + 3) * 1.0 / (pk % 4) ELSE ln + 3 END AS score FROM cigars")(
    lambda c: c.select("qname", "ln", "pk", sc.similarity_score(F.col("ln") + 3, F.col("pk") % 4).alias("score")))
query("seq_error", "qname:i ln:i artefact:b", "reads", "SELECT DISTINCT qname, ln, (ln * 3 < 13) AND (qty > 0) AND ((tag_as * 1.0 / qty <= 0.02) OR (tag_as = 1 AND qty >= 10)) AS artefact FROM reads")(
    lambda r: r.select("qname", "ln", sc.sequencing_error(F.col("ln") * 3, F.col("tag_as"), F.col("qty")).alias("artefact")).distinct())

# --- homology graph -----------------------------------------------------------------------
NODE = "concat_ws(':', chr_{i}, start_{i}, end_{i}, strand{i})"
EDGE_SQL = f"""SELECT least(x, y) AS a, greatest(x, y) AS b, coalesce(max(CASE WHEN x > y THEN rate END), max(rate)) AS weight FROM (SELECT {NODE.format(i=1)} AS x, {NODE.format(i=2)} AS y, rate FROM sd_pairs) e WHERE x <> y GROUP BY 1, 2"""
query("sd_edges", "a:s b:s weight:i", "sd_pairs", EDGE_SQL, given="pair_rows")(lambda p: graphs.homology_edges(p))
WO = """SELECT p.*, least(p.end_1, t."end") - greatest(p.start_1, t.start) AS overlap_len, t.target_id FROM sd_pairs p JOIN targets t ON p.chr_1 = t.chrom AND p.start_1 < t."end" AND t.start < p.end_1"""


def _on_targets(p: DataFrame, t: DataFrame) -> DataFrame:
    # large bins: pairs have many columns and few of them lie in two
    hit = intervals.overlaps(p.withColumnsRenamed({"chr_1": "chrom", "start_1": "start", "end_1": "end"}), t, 256)
    return hit.withColumnsRenamed({"chrom": "chr_1", "start": "start_1", "end": "end_1", "target_id_b": "target_id"})


def _on_target_groups(p: DataFrame, t: DataFrame) -> DataFrame:
    """Distinct pairs on targets, dealt by target."""
    return _on_targets(p, t).select("target_id", "chr_1", "start_1", "end_1", "chr_2", "start_2", "end_2", "strand1", "strand2", "overlap_len").repartition("target_id").distinct()


def _overlap_lengths(p: DataFrame, t: DataFrame) -> DataFrame:
    """Distinct pairs with the lengths by which targets overlap their side 1;
    dealt once, by side 1."""
    place = ["chr_1", "start_1", "end_1"]
    met = _on_targets(p.select(*place).distinct(), t.drop("target_id").distinct()).select(*place, "overlap_len").distinct()
    return p.join(met, place)


query("sd_overlap_filter", "chr_1:s start_1:i end_1:i chr_2:s start_2:i end_2:i strand1:s overlap_len:i", "sd_pairs targets", f"""SELECT DISTINCT chr_1, start_1, end_1, chr_2, start_2, end_2, CASE WHEN strand1 = '-' AND strand2 = '-' THEN '+' ELSE strand1 END AS strand1, overlap_len FROM ({WO}) x WHERE end_1 - start_1 > 10""", given="pair_rows targets")(
    lambda p, t: _overlap_lengths(p.where(F.col("end_1") - F.col("start_1") > 10), t).withColumn("strand1", F.when((F.col("strand1") == "-") & (F.col("strand2") == "-"), "+").otherwise(F.col("strand1"))).select("chr_1", "start_1", "end_1", "chr_2", "start_2", "end_2", "strand1", "overlap_len").distinct())
query("sd_umbrella", "target_id:i chr_1:s start_1:i end_1:i chr_2:s start_2:i end_2:i strand1:s strand2:s overlap_len:i", "sd_pairs targets", given="pair_rows targets")(
    lambda p, t: graphs.drop_umbrellas(_on_target_groups(p, t), "target_id"))


def _nodes(r: DataFrame) -> DataFrame:
    return r.where("mapq >= 50").select("chrom", "start", "end", "strand").distinct().withColumn("id", F.concat_ws(":", "chrom", "start", "end", "strand"))


PO_SQL = """WITH n AS (SELECT DISTINCT chrom, start, "end", concat_ws(':', chrom, start, "end", strand) AS id FROM reads WHERE mapq >= 50)
SELECT a.id AS a, b.id AS b, 1.0 / greatest(o * 1.0 / (a."end" - a.start), o * 1.0 / (b."end" - b.start)) AS weight, o AS overlap, least(a."end" - a.start, b."end" - b.start) - o AS rest
FROM (SELECT a, b, least(a."end", b."end") - greatest(a.start, b.start) AS o FROM n a JOIN n b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" AND a.id <> b.id) j
WHERE ("a"."end" - a.start) > (b."end" - b.start) OR ((a."end" - a.start) = (b."end" - b.start) AND (a.start > b.start OR (a.start = b.start AND a.id > b.id)))"""
query("po_edges", "a:s b:s weight:d overlap:i rest:i", "reads", PO_SQL)(lambda r: graphs.overlap_edges(_nodes(r)))
query("multiplex_graph", "a:s b:s type:s weight:d overlap:b", "sd_pairs reads", f"""WITH h AS ({EDGE_SQL}),
n AS (SELECT DISTINCT chrom, start, "end", concat_ws(':', chrom, start, "end", strand) AS id FROM reads WHERE mapq >= 50),
j AS (SELECT a.id AS ai, b.id AS bi, a."end" - a.start AS sa, b."end" - b.start AS sb, a.start AS st, b.start AS tb, least(a."end", b."end") - greatest(a.start, b.start) AS ov FROM n a JOIN n b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" AND a.id <> b.id),
p AS (SELECT ai AS a, bi AS b, 1.0 / greatest(ov * 1.0 / sa, ov * 1.0 / sb) AS w FROM j WHERE sa > sb OR (sa = sb AND (st > tb OR (st = tb AND ai > bi))))
SELECT coalesce(h.a, p.a) AS a, coalesce(h.b, p.b) AS b, CASE WHEN h.a IS NOT NULL THEN 'segmental_duplication' ELSE 'overlap' END AS type, coalesce(p.w, h.weight) AS weight, p.w IS NOT NULL AS overlap
FROM h FULL OUTER JOIN p ON h.a = p.a AND h.b = p.b""", given="pair_rows reads")(lambda p, r: graphs.compose(graphs.homology_edges(p), graphs.overlap_edges(_nodes(r))))
query("graph_prune", "a:s b:s weight:i", "sd_pairs", f"""WITH h AS ({EDGE_SQL}), big AS (SELECT DISTINCT {NODE.format(i=1)} AS id FROM sd_pairs WHERE end_1 - start_1 > 20 UNION SELECT DISTINCT {NODE.format(i=2)} FROM sd_pairs WHERE end_2 - start_2 > 20)
SELECT a, b, weight FROM h WHERE a IN (SELECT id FROM big) AND b IN (SELECT id FROM big)""", given="pair_rows")(
    lambda p: graphs.prune(graphs.homology_edges(graphs.large_pairs(p, 20)).withColumns({"type": F.lit("segmental_duplication"), "bases": F.lit(0)}), None, 20, 10))

query("components", "id:s component:s", "sd_pairs", f"""WITH h AS ({EDGE_SQL}), u AS (SELECT a, b FROM h UNION SELECT b, a FROM h),
c(id, l) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, c.l FROM c JOIN u ON u.a = c.id AND c.l < u.b)
SELECT id, min(l) AS component FROM c GROUP BY id""", given="pair_rows")(lambda p: graphs.components(graphs.links(p)))


def _component_edges(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    parts = graphs.stored(graphs.components(graphs.links(p)))
    # dealt by a, for the join too
    edges = graphs.homology_edges(p, by="a")
    return edges.join(parts.select(F.col("id").alias("a"), "component"), "a"), parts


@query("shortest_paths", "source:s target:s distance:d hops:i path:s valid:b", "sd_pairs", given="pair_rows")
def shortest_paths(p: DataFrame) -> DataFrame:
    """From each component's least vertex to all its others."""
    edges, parts = _component_edges(p)
    weighted = edges.select("a", "b", "component", (F.col("weight") / 100 + 0.01).alias("weight"), (F.col("weight") % 2 == 1).alias("overlap"))
    return graphs.shortest_paths(weighted, parts.where("id = component").select("component", F.col("id").alias("source")))


@query("coloring", "id:s colour:i", "sd_pairs", given="pair_rows")
def coloring(p: DataFrame) -> DataFrame:
    edges, parts = _component_edges(p)
    return graphs.colours(edges, parts)


@query("haplotypes", "chunk:s id:i clique:i hap:i", "reads")
def phased(r: DataFrame) -> DataFrame:
    """Read pairs phased in chunks of 100 positions by their overlaps; pairs on
    different strands conflict."""
    tile = r.where("mapq >= 30").select(F.concat_ws(":", "chrom", F.floor(F.col("start") / 100)).alias("chunk"), "start", "end", "strand", F.xxhash64("qname", "ln", "pk", "start").alias("id")).dropDuplicates(["id"])
    other = tile.select("chunk", *[F.col(c).alias(f"{c}_b") for c in ("start", "end", "strand", "id")])
    meet = tile.join(other, "chunk").where((F.col("id") < F.col("id_b")) & (F.col("start") < F.col("end_b")) & (F.col("start_b") < F.col("end")))
    weight = F.when(F.col("strand") == F.col("strand_b"), (F.least("end", "end_b") - F.greatest("start", "start_b")) / 50.0).otherwise(-1.0)
    edges = meet.select("chunk", F.col("id").alias("a"), F.col("id_b").alias("b"), weight.alias("weight"))
    return graphs.haplotypes(graphs.checkpointed(edges), graphs.checkpointed(tile.select("chunk", "id")))


# --- haplotype records -----------------------------------------------------------------------


def _records(r: DataFrame) -> DataFrame:
    """Reads grouped as haplotypes of windows."""
    base = r.select("chrom", (F.floor(F.col("start") / 120) * 120).cast("int").alias("start"), "pk", "mapq", "tag_xs", "qty", "xa")
    g = base.groupBy("chrom", "start", (F.col("pk") % 7).alias("hap")).agg(F.count("*").alias("hap_depth"), F.sum(F.col("mapq") / 10).cast("int").alias("var_count"), F.sum("tag_xs").cast("int").alias("indel_count"), F.max("qty").alias("similarity"), F.max("xa").alias("x"))
    return g.select("chrom", "start", (F.col("start") + 120).alias("end"), "hap", "hap_depth", "var_count", "indel_count", (F.col("similarity") / 8).alias("similarity"), ((F.col("x") == 1) & (F.col("hap_depth") > 6)).alias("extreme"), (F.col("hap_depth") < 2).alias("scatter"))


REC = """rec AS (SELECT chrom, start, start + 120 AS "end", hap, hap_depth, var_count, indel_count, q / 8.0 AS similarity, x = 1 AND hap_depth > 6 AS extreme, hap_depth < 2 AS scatter FROM (
  SELECT chrom, start // 120 * 120 AS start, pk % 7 AS hap, count(*) AS hap_depth, sum(mapq // 10) AS var_count, sum(tag_xs) AS indel_count, max(qty) AS q, max(xa) AS x FROM reads GROUP BY 1, 2, 3) y),
rk AS (SELECT *, dense_rank() OVER (PARTITION BY chrom, start ORDER BY var_count * 50 + indel_count) AS rank, sum(hap_depth) OVER (PARTITION BY chrom, start) AS total_depth FROM rec),
co AS (SELECT *, rank * 120 * sqrt(1.0 - hap_depth * 1.0 / total_depth) AS coefficient FROM rk)"""
HAP = "chrom:s start:i hap:i rank:i total_depth:i coefficient:d"
query("hap_rank", HAP, "reads", f"WITH {REC} SELECT chrom, start, hap, rank, total_depth, coefficient FROM co")(lambda r: reads.haplotype_ranks(_records(r)))
query("hap_filter", HAP, "reads", f"""WITH {REC}, kept AS (SELECT *, count(*) OVER (PARTITION BY chrom, start) AS n FROM co WHERE NOT extreme AND NOT scatter AND total_depth >= 5 AND similarity <= 5)
SELECT chrom, start, hap, rank, total_depth, coefficient FROM kept WHERE n >= 3""")(lambda r: reads.haplotype_filter(reads.haplotype_ranks(_records(r)), 5, 5))
query("decide", "chrom:s start:i hap:i mismapped:b", "reads", f"WITH {REC} SELECT chrom, start, hap, rank > 5 OR extreme OR similarity > 5 OR (scatter AND var_count > 1) AS mismapped FROM co")(
    lambda r: reads.decide(reads.haplotype_ranks(_records(r)).withColumn("dropped", F.col("rank") > 5)))


@query("ilp_select", "component:s hap_id:s dropped:b", "reads")
def ilp(r: DataFrame) -> DataFrame:
    """Which haplotypes each chain of five windows drops."""
    kept = reads.haplotype_filter(reads.haplotype_ranks(_records(r)), 5, 8)
    return graphs.select_drops(kept.select(F.concat_ws(":", "chrom", F.floor(F.col("start") / 600)).alias("component"), F.col("start").alias("window"), F.concat(F.lit("h"), F.col("hap").cast("string")).alias("hap_id"), "rank", (F.col("coefficient") + F.col("similarity")).alias("gain")))


query("consensus", "group:s pos:i value:i", "reads", """SELECT chrom AS "group", start AS pos, ln AS value FROM (SELECT *, row_number() OVER (PARTITION BY chrom, start ORDER BY tag_xs, qname DESC, ln DESC) AS n FROM reads WHERE tag_xs < 5) x WHERE n = 1""")(
    lambda r: reads.consensus(r.select(F.col("chrom").alias("group"), F.col("start").alias("pos"), F.col("ln").alias("value"), (F.col("tag_xs") / 50).alias("err"), F.struct("qname", "ln").alias("read"))))
query("pileup_ad", "chrom:s pos:i base:i ad:i dp:i", "reads", "SELECT chrom, start AS pos, pk % 4 AS base, count(*) AS ad, sum(count(*)) OVER (PARTITION BY chrom, start) AS dp FROM reads GROUP BY chrom, start, pk % 4")(
    lambda r: variants.allele_depths(r.select("chrom", F.col("start").alias("pos"), (F.col("pk") % 4).alias("base"))))

# --- variants -----------------------------------------------------------------------------------
SIDES = """q AS (SELECT * FROM variants WHERE side = 'q'), r AS (SELECT * FROM variants WHERE side = 'r')"""
VK = "chrom:s pos:i ref:s alt:s"


def _side(v: DataFrame, side: str) -> DataFrame:
    return v.where(F.col("side") == side).withColumns({"gt": F.when(F.col("ad_ref") > 0, "0/1").otherwise("1/1"), "filter": F.when(F.col("gq") > 5, F.array(F.lit("LOW"))).otherwise(F.expr("cast(array() as array<string>)"))})


query("vcf_norm", VK, "variants", "SELECT DISTINCT chrom, pos, ref, a AS alt FROM (SELECT chrom, pos, ref, unnest(CASE WHEN hp = 0 THEN [alt, '*'] ELSE [alt, ref || 'A'] END) AS a FROM variants) x WHERE a <> '*'")(
    lambda v: variants.normalise(v.select("chrom", "pos", F.lower("ref").alias("ref"), F.array("alt", F.when(F.col("hp") == 0, "*").otherwise(F.concat("ref", F.lit("A")))).alias("alts"))))
RATIO = "({s}.ad_alt * 1.0 / nullif({s}.ad_ref + {s}.ad_alt, 0))"
GT = "CASE WHEN {s}.ad_ref > 0 THEN '0/1' ELSE '1/1' END"
FL = "CASE WHEN {s}.gq > 5 THEN 'LOW;' ELSE '' END"
MERGED = f"""WITH {SIDES} SELECT coalesce(q.chrom, r.chrom) AS chrom, coalesce(q.pos, r.pos) AS pos, coalesce(q.ref, r.ref) AS ref, coalesce(q.alt, r.alt) AS alt,
 CASE WHEN q.chrom IS NULL THEN 'reference' WHEN r.chrom IS NULL THEN 'query' ELSE 'both' END AS side,
 {{gt}} AS gt,
 CASE WHEN q.chrom IS NULL THEN {FL.format(s="r")} || 'CLEAN' WHEN r.chrom IS NULL THEN {FL.format(s="q")} || 'RAW;MISALIGNED' ELSE {FL.format(s="r")} || 'RAW;CLEAN' END AS filter
FROM q FULL OUTER JOIN r ON q.chrom = r.chrom AND q.pos = r.pos AND q.ref = r.ref AND q.alt = r.alt"""
PLAIN_GT = f"CASE WHEN r.chrom IS NULL THEN {GT.format(s='q')} ELSE {GT.format(s='r')} END"
FIXED_GT = f"""CASE WHEN q.chrom IS NOT NULL AND r.chrom IS NOT NULL AND ({RATIO.format(s="r")} >= 0.9 OR (r.hp >= 2 AND {RATIO.format(s="r")} >= 0.7) OR (r.gq < 5 AND {RATIO.format(s="r")} >= 0.7 AND r.ad_ref + r.ad_alt > 5)) THEN '1/1'
 WHEN r.chrom IS NULL AND ((q.hp >= 2 AND {RATIO.format(s="q")} >= 0.55 AND q.ad_ref + q.ad_alt >= 5) OR (q.hp >= 4 AND q.ad_alt >= q.ad_ref AND q.ad_ref + q.ad_alt >= 5) OR ({RATIO.format(s="q")} >= 0.9 AND q.ad_ref + q.ad_alt >= 5)) THEN '1/1'
 WHEN q.chrom IS NULL AND r.gq < 5 AND {RATIO.format(s="r")} >= 0.7 THEN '1/1' ELSE {PLAIN_GT} END"""
VM = f"{VK} side:s gt:s filter:s"
query("merge_priority", VM, "variants", MERGED.format(gt=PLAIN_GT))(lambda v: variants.merge_priority(_side(v, "q"), _side(v, "r"), fix_genotypes=False))
query("merge_gt_fix", VM, "variants", MERGED.format(gt=FIXED_GT))(lambda v: variants.merge_priority(_side(v, "q"), _side(v, "r")))
query("inhouse_common", f"{VK} tag:s", "variants", f"""WITH {SIDES} SELECT q.chrom, q.pos, q.ref, q.alt, CASE WHEN (SELECT sum(exp(lgamma(r.an + 1) - lgamma(i + 1) - lgamma(r.an - i + 1) + i * ln(0.01) + (r.an - i) * ln(0.99))) FROM (SELECT unnest(generate_series(0, CAST(r.ac AS BIGINT))) AS i) s) > 0.999 THEN 'INHOUSE_COMMON' ELSE '' END AS tag
FROM q LEFT JOIN r ON q.chrom = r.chrom AND q.pos = r.pos AND q.ref = r.ref AND q.alt = r.alt""")(lambda v: variants.annotate_common(_side(v, "q"), _side(v, "r")))
query("vcf_region", VK, "variants targets", """SELECT chrom, pos, ref, alt FROM variants v WHERE side = 'q' AND EXISTS (SELECT 1 FROM targets t WHERE t.chrom = v.chrom AND v.pos - 1 < t."end" AND t.start < v.pos)""")(
    lambda v, t: variants.in_regions(v.where("side = 'q'"), t))
WEAK = "coalesce(({n}_alt <= 1) OR ({n}_alt * 1.0 / nullif({n}_dp, 0) <= 0.1), true)"
query("lost_alt", VK, "variants", f"""WITH t AS (SELECT chrom, pos, ref, alt, ad_alt AS re_alt, ad_alt + ad_ref AS re_dp, gq AS high_alt, an AS high_dp, hp AS low_alt, ac AS low_dp FROM variants WHERE side = 'q')
SELECT chrom, pos, ref, alt FROM t WHERE NOT ({WEAK.format(n="re")} AND ({WEAK.format(n="high")} OR {WEAK.format(n="low")}))""")(
    lambda v: variants.lost_alt(v.where("side = 'q'").select("chrom", "pos", "ref", "alt", F.col("ad_alt").alias("re_alt"), (F.col("ad_alt") + F.col("ad_ref")).alias("re_dp"), F.col("gq").alias("high_alt"), F.col("an").alias("high_dp"), F.col("hp").alias("low_alt"), F.col("ac").alias("low_dp"))))
query("isec_private", VK, "variants", f"WITH {SIDES} SELECT q.chrom, q.pos, q.ref, q.alt FROM q ANTI JOIN r ON q.chrom = r.chrom AND q.pos = r.pos AND q.ref = r.ref AND q.alt = r.alt")(
    lambda v: v.where("side = 'q'").join(v.where("side = 'r'"), variants.KEY, "left_anti"))
query("soft_filter", f"{VK} filter:s", "variants", "SELECT chrom, pos, ref, alt, CASE WHEN gq > 5 THEN CASE WHEN ac >= 20 THEN 'LOW;AF' ELSE 'LOW' END WHEN ac >= 20 THEN 'AF' ELSE '' END AS filter FROM variants WHERE side = 'q'")(
    lambda v: variants.soft_filter(_side(v, "q"), F.col("ac") >= 20, "AF").withColumn("filter", F.array_join("filter", ";")))
query("prec_recall", "truth:i called:i hits:i false_positive:i missed:i accurate:i het_as_hom:i hom_as_het:i recall:d precision:d", "variants", f"""WITH {SIDES}, j AS (SELECT CASE WHEN q.chrom IS NOT NULL THEN {GT.format(s="q")} END AS t, CASE WHEN r.chrom IS NOT NULL THEN {GT.format(s="r")} END AS c
 FROM q FULL OUTER JOIN r ON q.chrom = r.chrom AND q.pos = r.pos AND q.ref = r.ref AND q.alt = r.alt)
SELECT count(t) AS truth, count(c) AS called, count(CASE WHEN t IS NOT NULL AND c IS NOT NULL THEN 1 END) AS hits, count(CASE WHEN t IS NULL THEN 1 END) AS false_positive, count(CASE WHEN c IS NULL THEN 1 END) AS missed, count(CASE WHEN t = c THEN 1 END) AS accurate,
 count(CASE WHEN t = '0/1' AND c = '1/1' THEN 1 END) AS het_as_hom, count(CASE WHEN t = '1/1' AND c = '0/1' THEN 1 END) AS hom_as_het, hits * 1.0 / nullif(count(t), 0) AS recall, hits * 1.0 / nullif(count(c), 0) AS precision FROM j""")(
    lambda v: variants.precision_recall(_side(v, "q"), _side(v, "r")))
query("hp_support", f"{VK} hpsup:s", "variants reads", """WITH b AS (SELECT DISTINCT chrom, CAST(start // 7 AS INT) AS pos, substr('ACGT', CAST(pk % 4 AS INT) + 1, 1) AS base, ln % 4 AS hp FROM reads WHERE mapq >= 10 AND ln * 6 >= 15)
SELECT v.chrom, v.pos, v.ref, v.alt, coalesce(string_agg(DISTINCT CAST(b.hp AS VARCHAR), ';' ORDER BY CAST(b.hp AS VARCHAR)), '.') AS hpsup FROM variants v LEFT JOIN b ON b.chrom = v.chrom AND b.pos = v.pos AND b.base = v.alt WHERE v.side = 'q' GROUP BY v.chrom, v.pos, v.ref, v.alt""")(
    lambda v, r: variants.haplotype_support(r.select("chrom", F.floor(F.col("start") / 7).cast("int").alias("pos"), F.expr("substr('ACGT', cast(pk % 4 as int) + 1, 1)").alias("base"), (F.col("ln") % 4).alias("hp"), "mapq", (F.col("ln") * 6).alias("bq")), v.where("side = 'q'")))
query("upsert", "chrom:s pos:i ref:s alt:s ac:i", "variants", f"WITH {SIDES} SELECT chrom, pos, ref, alt, ac FROM r UNION ALL SELECT q.chrom, q.pos, q.ref, q.alt, q.ac FROM q ANTI JOIN r ON q.chrom = r.chrom AND q.pos = r.pos AND q.ref = r.ref AND q.alt = r.alt")(
    lambda v: variants.upsert(v.where("side = 'q'"), v.where("side = 'r'"), variants.KEY))

# --- lookups between variant sets ------------------------------------------------------------------
query("vcf_annotate", f"{VK} ac_r:s an_r:s", "variants", f"WITH {SIDES} SELECT q.chrom, q.pos, q.ref, q.alt, r.ac AS ac_r, r.an AS an_r FROM q LEFT JOIN r ON q.chrom = r.chrom AND q.pos = r.pos AND q.ref = r.ref AND q.alt = r.alt")(
    lambda v: variants.annotate(v.where("side = 'q'"), v.where("side = 'r'").select(*variants.KEY, F.col("ac").alias("ac_r"), F.col("an").alias("an_r")), ["ac_r", "an_r"]))
for _mode, _on in (("site", "q.chrom = r.chrom AND q.pos = r.pos"), ("exact", f"q.chrom = r.chrom AND q.pos = r.pos AND q.ref = r.ref AND q.alt = r.alt AND {GT.format(s='q')} = {GT.format(s='r')}")):
    query(f"vcf_members_{_mode}", VK, "variants", f"WITH {SIDES} SELECT q.chrom, q.pos, q.ref, q.alt FROM q SEMI JOIN r ON {_on}")(lambda v, m=_mode: variants.members(_side(v, "q"), _side(v, "r"), m))
query("depth_lookup", f"{VK} deep_dp:i deep_alt:i", "variants reads", f"""WITH {SIDES}, t AS (SELECT chrom, CAST(start // 7 AS INT) AS pos, substr('ACGT', CAST(pk % 4 AS INT) + 1, 1) AS base FROM reads WHERE mapq >= 10)
SELECT q.chrom, q.pos, q.ref, q.alt, (SELECT nullif(count(*), 0) FROM t WHERE t.chrom = q.chrom AND t.pos = q.pos) AS deep_dp,
 CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.chrom = q.chrom AND t.pos = q.pos) THEN (SELECT count(*) FROM t WHERE t.chrom = q.chrom AND t.pos = q.pos AND t.base = q.alt) END AS deep_alt FROM q""")(
    lambda v, r: variants.depth_lookup(v.where("side = 'q'"), deep=variants.allele_depths(r.where("mapq >= 10").select("chrom", F.floor(F.col("start") / 7).cast("int").alias("pos"), F.expr("substr('ACGT', cast(pk % 4 as int) + 1, 1)").alias("base")))))

# --- reads and their names ---------------------------------------------------------------------------
STATUS = "CASE WHEN max(tag_xs) >= 8 THEN 'lowqual' WHEN max(xa) = 1 THEN 'mismapped' WHEN min(ln) > 1 THEN 'noisy' ELSE 'correct' END"
query("classify_reads", "qname:i ln:i pk:i start:i tag:s kept:b", "reads", f"""WITH n AS (SELECT qname, min(pk) % 7 AS hap, {STATUS} AS status FROM reads GROUP BY qname)
SELECT r.qname, ln, pk, start, CASE WHEN status = 'lowqual' THEN 'LOWQUAL' ELSE 'chunk0_' || hap || CASE WHEN status = 'correct' THEN '' ELSE '_HIGHVD' END END AS tag, mapq > 10 AND (flag & 1540) = 0 AND status = 'correct' AS kept FROM reads r JOIN n ON n.qname = r.qname WHERE (flag & 2304) = 0""")(
    lambda r: reads.classified(r, r.groupBy("qname").agg((F.min("pk") % 7).alias("hap"), F.expr(STATUS).alias("status")), "0"))
query("first_alignments", "origin:s chrom:s start:i scan:i", "reads", """SELECT origin, chrom, start, scan FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY scan, chrom, start) AS n FROM (SELECT DISTINCT chrom, start, flag, 'S' || sk || ':' || (start - start % 50 + 1) || '-' || (start + 100) AS origin, qname * 100 + ln * 10 + pk % 10 AS scan FROM reads) x) y
WHERE n = 1 AND (flag & 2052) = 0 AND NOT (start % 50 = 0)""")(
    lambda r: reads.first_alignments(r.select("chrom", "start", "flag", F.concat(F.lit("S"), "sk", F.lit(":"), F.col("start") - F.col("start") % 50 + 1, F.lit("-"), F.col("start") + 100).alias("origin"), (F.col("qname") * 100 + F.col("ln") * 10 + F.col("pk") % 10).alias("scan")).distinct().withColumn("scan", F.struct("scan", "chrom", "start"))).withColumn("scan", F.col("scan.scan")))
query("mismatch_limit", "rate:d cutoff:i", "cigars", VEC + """, a AS (SELECT avg(v[2] + v[3] + v[5] - greatest(CASE WHEN v[3] > 1 THEN v[3] ELSE 0 END, CASE WHEN v[5] > 1 THEN v[5] ELSE 0 END)) AS rate FROM n),
c AS (SELECT rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT rate, unnest(generate_series(0, 99)) AS k FROM a) x)
SELECT rate, greatest(4, min(k)) AS cutoff FROM c WHERE s >= 0.95 GROUP BY rate""")(
    lambda c: reads.mismatch_limit(c.withColumn("nm", F.aggregate(F.filter(sc.cigar_ops(F.col("cigar")), lambda x: x["op"].isin("X", "I", "D")), F.lit(0), lambda a, x: a + x["len"]))))
query("hap_depth", "chrom:s start:i hap:i hap_depth:i total_depth:i", "reads", """WITH g AS (SELECT chrom, start // 120 * 120 AS start, pk % 7 AS hap, count(*) * 25.0 / greatest(max("end") - min(start), 25) AS d FROM reads GROUP BY 1, 2, 3)
SELECT chrom, start, hap, floor(d) AS hap_depth, floor(sum(d) OVER (PARTITION BY chrom, start) + 1e-9) AS total_depth FROM g""")(
    lambda r: reads.haplotype_depths(r.groupBy("chrom", (F.floor(F.col("start") / 120) * 120).alias("w"), (F.col("pk") % 7).alias("hap")).agg(F.count("*").alias("n_reads"), (F.max("end") - F.min("start")).alias("span")).select("chrom", F.col("w").alias("start"), (F.col("w") + 120).alias("end"), "hap", "n_reads", "span"), 25))
SPANS = f"""sp AS ({MERGE.format(k="chrom, hap", g=0, t="(SELECT chrom, start, \"end\", pk % 7 AS hap FROM reads)")})"""
query("window_haplotypes", "chrom:s start:i end:i hap:i span_start:i span_end:i", "reads", f"""WITH {BLOCKS.format(k=5)}, {SPANS},
wi AS (SELECT DISTINCT chrom, w AS start, least(w + 30, "end") AS "end" FROM (SELECT chrom, "end", unnest(generate_series(start, "end" - 1, 30)) AS w FROM mrg) x),
h AS (SELECT wi.*, sp.hap, sp.start AS s, sp."end" AS e, sp.start <= wi.start AND sp."end" >= wi."end" AS enc, least(wi."end", sp."end") - greatest(wi.start, sp.start) >= 0.8 * (wi."end" - wi.start) AS big FROM wi JOIN sp ON wi.chrom = sp.chrom AND wi.start < sp."end" AND sp.start < wi."end"),
g AS (SELECT chrom, start, "end", sum(CASE WHEN enc THEN 1 ELSE 0 END) AS whole, sum(CASE WHEN enc OR big THEN 1 ELSE 0 END) AS n, max(CASE WHEN big AND NOT enc THEN s END) AS lo, min(CASE WHEN big AND NOT enc THEN e END) AS hi FROM h GROUP BY ALL)
SELECT h.chrom, CASE WHEN whole > 2 THEN h.start ELSE greatest(h.start, lo) END AS start, CASE WHEN whole > 2 THEN h."end" ELSE least(h."end", hi) END AS "end", hap, s AS span_start, e AS span_end
FROM h JOIN g ON h.chrom = g.chrom AND h.start = g.start AND h."end" = g."end" WHERE (whole > 2 AND enc) OR (whole <= 2 AND n > 2 AND n > whole AND (enc OR big))""")(
    lambda r: reads.window_haplotypes(intervals.windows(intervals.depth_blocks(intervals.depth_runs(r), 5, one_based=False), 30, 30), intervals.merge(r.select("chrom", "start", "end", (F.col("pk") % 7).alias("hap")), 0, ("chrom", "hap"))))

# --- vectors ---------------------------------------------------------------------------------------------
query("stretches", "qname:i ln:i pk:i start:i end:i", "cigars", VEC + """ SELECT qname, ln, pk, v[1] AS start, v[1] + v[2] + CASE WHEN v[4] = 1 THEN v[5] ELSE 0 END AS "end" FROM n
UNION ALL SELECT qname, ln, pk, v[1] + v[2] + v[4], v[1] + v[2] + v[4] + v[5] - 1 FROM n WHERE v[4] > 1""")(
    lambda c: c.select("qname", "ln", "pk", F.explode(sc.stretches(F.transform(sc.read_vector(sc.cigar_ops(F.col("cigar"))), lambda v: v != sc.MATCH))).alias("x")).select("qname", "ln", "pk", "x.start", "x.end"))
KIND = """, b AS (SELECT qname, ln, pk, v, unnest(generate_series(0, v[1] + v[2] + v[4] + v[5] + v[6] - 1)) AS i FROM n),
k AS (SELECT *, CASE WHEN i BETWEEN v[1] AND v[1] + v[2] - 1 THEN 1 WHEN i = v[1] + v[2] OR i BETWEEN v[1] + v[2] + v[4] AND v[1] + v[2] + v[4] + v[5] - 1 THEN 2 ELSE 0 END AS kind FROM b),
o AS (SELECT *, CASE WHEN kind > 0 AND kind <> coalesce(lag(kind) OVER (PARTITION BY qname, ln, pk, v ORDER BY i), 0) THEN 1 ELSE 0 END AS opens FROM k),
d AS (SELECT *, sum(opens) OVER w + CASE WHEN first_value(kind) OVER w > 0 AND first_value(opens) OVER w = 0 THEN 1 ELSE 0 END AS blocks FROM o WINDOW w AS (PARTITION BY qname, ln, pk, v ORDER BY i ROWS BETWEEN 42 PRECEDING AND 41 FOLLOWING))"""
query("var_density", "qname:i ln:i pk:i most:d total:d", "cigars", VEC + KIND + " SELECT qname, ln, pk, max(blocks) / 85.0 AS most, sum(blocks) / 85.0 AS total FROM d GROUP BY qname, ln, pk, v")(
    lambda c: c.select("qname", "ln", "pk", sc.densities(sc.read_vector(sc.cigar_ops(F.col("cigar"))), 42).alias("d")).select("qname", "ln", "pk", F.array_max("d").alias("most"), F.aggregate("d", F.lit(0.0), lambda a, x: a + x).alias("total")))
query("extreme_density", "qname:i ln:i pk:i extreme:b", "cigars")(
    lambda c: c.select("qname", "ln", "pk", sc.extreme_density(sc.read_vector(sc.cigar_ops(F.col("cigar")))).alias("extreme")))
query("ref_similarity", "qname:i ln:i pk:i size:i other:i", "cigars", VEC + " SELECT qname, ln, pk, CASE WHEN v[4] = 1 THEN 2 ELSE 3 END AS size, 1 + CASE WHEN v[4] = 1 THEN 0 ELSE 1 END + CASE WHEN v[6] > 1 OR v[5] = 0 THEN 1 ELSE 0 END AS other FROM n")(
    lambda c: c.select("qname", "ln", "pk", sc.read_vector(sc.cigar_ops(F.col("cigar"))).alias("v")).select("qname", "ln", "pk", sc.reference_similarity(F.col("v"), F.concat(F.array_repeat(F.lit(1), F.size("v") - 1), F.array(F.lit(sc.MISMATCH)))).alias("s")).select("qname", "ln", "pk", "s.size", "s.other"))


def _sequenced(r: DataFrame, c: DataFrame) -> DataFrame:
    """Reads with the base ACGT[pos % 4] at each place before an insertion."""
    seq = F.substring(F.repeat(F.lit("ACGT"), 60), F.col("start") % 4 + 1, 200)
    quals = F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: (i * 7 + F.col("qname")) % 30 + 5)
    some = r.select("qname", "ln", "pk", "chrom", "start").distinct().join(c, ["qname", "ln", "pk"])
    return some.select(F.concat_ws(":", "qname", "ln", "pk", "chrom", "start", "cigar").alias("id"), "qname", "chrom", "start", "cigar", seq.alias("seq"), quals.alias("quals"))


@query("phase_edges", "a:i b:i weight:d", "reads cigars")
def phase_edges(r: DataFrame, c: DataFrame) -> DataFrame:
    """How surely two read pairs come from one haplotype."""
    return phasing.phase_edges(phasing.compared_pairs(phasing.described(_sequenced(r, c)), 25.0), 25.0)


# --- counterparts and groups ---------------------------------------------------------------------------------
query("adjusted_strand", "chr_1:s start_1:i chr_2:s start_2:i strand:s", "sd_pairs", "SELECT chr_1, start_1, chr_2, start_2, CASE WHEN strand1 = '-' THEN CASE WHEN strand2 = '+' THEN '-' ELSE '+' END ELSE strand2 END AS strand FROM sd_pairs")(
    lambda p: p.select("chr_1", "start_1", "chr_2", "start_2", sc.adjusted_strand(F.col("strand1"), F.col("strand2")).alias("strand")))
query("iv_lift_rel", "grp:s chrom:s start:i end:i", "sd_pairs targets", f"""WITH p AS (SELECT DISTINCT chr_1, start_1, end_1, strand1, chr_2, start_2, end_2, strand2, concat_ws(':', chr_1, start_1, end_1, strand1, chr_2, start_2, end_2, strand2) AS grp FROM sd_pairs),
rel AS (SELECT p.*, greatest(0, t.start - start_1 - 2) AS start, least(end_1 - start_1, t."end" - start_1 + 2) AS "end" FROM p JOIN targets t ON p.chr_1 = t.chrom AND p.start_1 < t."end" AND t.start < p.end_1),
m AS ({MERGE.format(k="grp, chr_2, start_2, end_2, end_1, start_1, strand1, strand2", g=0, t="rel")})
SELECT * FROM (SELECT grp, chr_2 AS chrom, greatest(start_2, CASE WHEN strand1 = strand2 THEN start_2 + start ELSE end_2 - "end" END) AS start, least(end_2, CASE WHEN strand1 = strand2 THEN start_2 + "end" ELSE end_2 - start END) AS "end" FROM m) x WHERE start < "end" """)(
    lambda p, t: intervals.lift_pairs(p.drop("rate"), t, 2).select(F.concat_ws(":", "chr_1", "start_1", "end_1", "strand1", "chr_2", "start_2", "end_2", "strand2").alias("grp"), F.col("chr_2").alias("chrom"), "start", "end"))
query("vertex_loads", "id:s degree:i load:i", "sd_pairs", f"""WITH h AS ({EDGE_SQL}), u AS (SELECT a, b FROM h UNION SELECT b, a FROM h),
c(id, l) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, c.l FROM c JOIN u ON u.a = c.id AND c.l < u.b),
p AS (SELECT id, min(l) AS part FROM c GROUP BY id), s AS (SELECT part, count(*) AS n FROM p GROUP BY part), g AS (SELECT a AS id, count(*) AS degree FROM u GROUP BY a)
SELECT p.id, degree, degree * n AS load FROM p JOIN s ON s.part = p.part JOIN g ON g.id = p.id""", given="pair_rows")(lambda p: graphs.loads(graphs.homology_edges(p), graphs.components(graphs.links(p))))


def _counterparts(p: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges, parts = _component_edges(p)
    place = F.split("id", ":")
    nodes = parts.select("id", "component", place[0].alias("chrom"), place[1].cast("int").alias("start"), place[2].cast("int").alias("end"), place[3].alias("strand"))
    weighted = edges.select("a", "b", "component", (F.col("weight") / 200).alias("weight"), F.lit(False).alias("overlap"))
    return paralogs.counterparts(weighted, nodes, nodes.select(F.col("id").alias("source"), "component"), least=5), nodes, parts


@query("counterparts", "source:s target:s chrom:s start:i end:i strand:s rel_start:i rel_end:i identity:d", "sd_pairs", given="pair_rows")
def counterparts(p: DataFrame) -> DataFrame:
    """The windows that each region's homologies lead to."""
    return _counterparts(p)[0]


@query("group_regions", "chrom:s start:i end:i rel_start:i rel_end:i strand:s tag:s", "sd_pairs", given="pair_rows")
def group_regions(p: DataFrame) -> DataFrame:
    """Realign groups: conflict-free queries with their counterparts."""
    found, nodes, parts = _counterparts(p)
    found = graphs.stored(found)
    clash = paralogs.conflicts(found, nodes).join(parts.select(F.col("id").alias("a"), "component"), "a")
    groups = paralogs.realign_groups(found, graphs.colours(clash, parts), nodes)
    return paralogs.group_regions(groups, found, nodes)
