"""Queries of filters, projections, set operations, statistics and column
functions that the larger queries don't show, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import graphs, intervals, reads, variants
from .queries import IV, MERGE, NODE, READ, REC, SIDES, VEC, VK, WO, _on_target_groups, _records, _side, query

# --- filters and projections ----------------------------------------------------------
CONTIGS = ["chr1", "chrX", "MT", "CHR2", "chrUn_1", "HLA-A", "7", "chrM1", "chr"]
PICK = f"list_value({', '.join(repr(c) for c in CONTIGS)})[CAST(qname % {len(CONTIGS)} + 1 AS BIGINT)]"


def _contig():
    return F.element_at(F.array(*[F.lit(c) for c in CONTIGS]), (F.col("qname") % len(CONTIGS) + 1).cast("int"))


query("contig_filter", "qname:i contig:s annotated:b", "reads", f"""SELECT qname, contig, regexp_matches(contig, '^chr[0-9MTXY]+$') AS annotated FROM (SELECT qname, {PICK} AS contig FROM reads) x WHERE regexp_matches(contig, '^(chr)?([0-9]+|[XYM]|MT)$', 'i')""")(
    lambda r: r.select("qname", _contig().alias("contig")).where(sc.is_main_contig(F.col("contig"))).withColumn("annotated", sc.is_annotated_contig(F.col("contig"))))
PATHS = ["/d/HG002.hg38.bam", "x/s1_GRCh37.vcf.gz", "a.b/t2t.fa", "sample", "/r/NA12878.CHM13.x", "g/hg19"]
FILES = f"list_value({', '.join(repr(c) for c in PATHS)})[CAST(ln % {len(PATHS)} + 1 AS BIGINT)]"
query("name_parts", "qname:i path:s assembly:s sample:s label:s", "reads", f"""SELECT qname, path, CASE WHEN regexp_matches(lower(path), 'hg19|grch37') THEN 'hg19' WHEN regexp_matches(lower(path), 'hg38|grch38') THEN 'hg38' WHEN regexp_matches(lower(path), 'chm13|t2t') THEN 'chm13' END AS assembly,
 split_part(list_extract(string_split(path, '/'), -1), '.', 1) AS sample, 'RG' || (pk % 12) AS label FROM (SELECT qname, pk, {FILES} AS path FROM reads) x""")(
    lambda r: r.select("qname", "pk", F.element_at(F.array(*[F.lit(c) for c in PATHS]), (F.col("ln") % len(PATHS) + 1).cast("int")).alias("path")).select("qname", "path", sc.assembly(F.col("path")).alias("assembly"), sc.sample_name(F.col("path")).alias("sample"), sc.group_label(F.when(F.col("pk") % 2 == 0, (F.col("pk") % 12).cast("string")).otherwise(F.concat(F.lit("RG"), F.col("pk") % 12))).alias("label")))
query("insert_eligible", READ, "reads", """SELECT chrom, start, "end", qname, mapq FROM reads WHERE (flag & 2) <> 0 AND (flag & 2316) = 0 AND xa = 0 AND abs(pk % 100 - 50) <= 30""")(
    lambda r: reads.for_insert_sizes(r.withColumns({"mate_chrom": F.when(F.col("xa") == 0, F.col("chrom")).otherwise("other"), "tlen": F.col("pk") % 100 - 50}), 30))
query("nm_eligible", READ, "reads", """SELECT chrom, start, "end", qname, mapq FROM reads WHERE (flag & 2) <> 0 AND (flag & 3844) = 0 AND xa = 0 AND mapq = 60""")(lambda r: reads.for_mismatches(r))
SHARE = "CAST('0x' || substr(md5(qname || ':{run}'), 1, 8) AS BIGINT) % 1000 < {n}"
query("sample_bernoulli", "qname:i ln:i run:i", "reads", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT qname, ln, {k} AS run FROM reads WHERE {SHARE.format(run=k, n=30)}" for k in range(3)) + ") x")(
    lambda r: reads.sampled(r, 30, 0).withColumn("run", F.lit(0)).unionByName(reads.sampled(r, 30, 1).withColumn("run", F.lit(1))).unionByName(reads.sampled(r, 30, 2).withColumn("run", F.lit(2))))
query("sample_pairs", READ, "reads", f"""SELECT chrom, start, "end", qname, mapq FROM reads WHERE {SHARE.format(run=7, n=333)}""")(lambda r: reads.sampled(r, 333, 7))
query("first_reads_mean", "mean:d n:i", "reads", "SELECT avg(qty) AS mean, count(*) AS n FROM (SELECT qty FROM reads ORDER BY qname, ln, pk, start, qty LIMIT 5000) x")(
    lambda r: reads.first_rows(r, 5000, F.col("qname"), F.col("ln"), F.col("pk"), F.col("start"), F.col("qty")).agg(F.avg("qty").alias("mean"), F.count("*").alias("n")))
query("averaged_insert_stats", "mean:d median:d deviation:d", "reads", "WITH r AS (" + " UNION ALL ".join(f"SELECT {k} AS run, qty AS size FROM reads WHERE {SHARE.format(run=k, n=200)}" for k in range(3)) + """), t AS (SELECT run, quantile_cont(size, 0.99) AS top FROM r GROUP BY run),
s AS (SELECT r.run, avg(size) AS mean, median(size) AS median, stddev_pop(size) AS deviation FROM r JOIN t ON r.run = t.run WHERE size <= top GROUP BY r.run) SELECT avg(mean) AS mean, avg(median) AS median, avg(deviation) AS deviation FROM s""")(
    lambda r: reads.averaged_insert_statistics(r.withColumn("size", F.col("qty")), 3, 200))
query("first_seen", "qname:i place:i", "reads", "SELECT qname, row_number() OVER (ORDER BY seen, qname) AS place FROM (SELECT qname, min(start * 100000 + pk) AS seen FROM reads WHERE mapq >= 60 GROUP BY qname) x")(
    lambda r: r.where("mapq >= 60").groupBy("qname").agg(F.min(F.col("start") * 100000 + F.col("pk")).alias("seen")).select("qname", F.row_number().over(Window.orderBy("seen", "qname")).alias("place")))
query("unordered_pairs", "x:s y:s rate:i", "sd_pairs", f"""WITH p AS (SELECT {NODE.format(i=1)} AS x, {NODE.format(i=2)} AS y, rate FROM sd_pairs) SELECT x, y, rate FROM (SELECT *, row_number() OVER (PARTITION BY least(x, y), greatest(x, y) ORDER BY x, y, rate) AS n FROM p) z WHERE n = 1""", given="pair_rows")(
    lambda p: reads.first_of_unordered(graphs.links(p, "rate")).select("x", "y", "rate"))
query("distinct_without_nulls", "chrom:s mapq:i part:i", "reads", "SELECT DISTINCT chrom, mapq, pk % 4 AS part FROM reads WHERE pk % 4 > 0 AND mapq > 20")(
    lambda r: r.select("chrom", F.when(F.col("mapq") > 20, F.col("mapq")).alias("mapq"), F.when(F.col("pk") % 4 > 0, F.col("pk") % 4).alias("part")).dropDuplicates().na.drop())
query("bed_order", "chrom:s start:i end:i place:i", "reads", """SELECT chrom, start, "end", row_number() OVER (PARTITION BY chrom ORDER BY start, "end") AS place FROM (SELECT DISTINCT chrom, start, "end" FROM reads) x""")(
    lambda r: r.select("chrom", "start", "end").distinct().withColumn("place", F.row_number().over(Window.partitionBy("chrom").orderBy("start", "end"))))
query("rename_split", "qname:i place:i piece:s", "reads", """SELECT qname, unnest([0, 1, 2]) AS place, unnest([chrom, CAST(start AS VARCHAR), strand]) AS piece FROM reads""")(
    lambda r: r.withColumnsRenamed({"chrom": "contig"}).select("qname", F.posexplode(F.split(F.rtrim(F.replace(F.concat_ws(";", "contig", "start", F.concat("strand", F.lit("  "))), F.lit(";"), F.lit(","))), ",")).alias("place", "piece")))
query("map_default", "qname:i flagged:b score:d", "reads", "SELECT qname, coalesce(s, false) AS flagged, coalesce(v, 0) AS score FROM reads r LEFT JOIN (SELECT DISTINCT pk % 50 AS k, pk % 2 = 0 AS s, (pk % 50) / 4.0 AS v FROM reads WHERE pk % 50 < 20) m ON r.pk % 50 = m.k")(
    lambda r: r.withColumn("k", F.col("pk") % 50).join(F.broadcast(r.where("pk % 50 < 20").select((F.col("pk") % 50).alias("k"), (F.col("pk") % 2 == 0).alias("s"), (F.col("pk") % 50 / 4).alias("v")).distinct()), "k", "left").select("qname", F.coalesce("s", F.lit(False)).alias("flagged"), F.coalesce("v", F.lit(0.0)).alias("score")))
query("tag_prefix", "tag:s n:i", "reads", "SELECT tag, count(*) AS n FROM (SELECT CASE WHEN xa = 1 THEN 'FC' ELSE 'NFC' END || ':RG' || (pk % 6) || '_0' AS tag FROM reads) x WHERE starts_with(tag, 'FC') OR tag = 'NFC:RG3_0' GROUP BY tag")(
    lambda r: r.select(F.concat(F.when(F.col("xa") == 1, "FC").otherwise("NFC"), F.lit(":RG"), F.col("pk") % 6, F.lit("_0")).alias("tag")).where(F.col("tag").startswith("FC") | (F.col("tag") == "NFC:RG3_0")).groupBy("tag").agg(F.count("*").alias("n")))
query("bed_problems", "chrom:s start:i end:i problem:s", "reads", """SELECT * FROM (SELECT chrom, start, "end", CASE WHEN chrom IS NULL THEN 'no chrom' WHEN "end" IS NULL THEN 'no coordinates' WHEN start < 0 THEN 'negative start' WHEN "end" <= start THEN 'empty' END AS problem FROM (SELECT CASE WHEN ln = 1 THEN NULL ELSE chrom END AS chrom, start - CASE WHEN ln = 2 THEN 5000 ELSE 0 END AS start, CASE WHEN ln = 3 THEN NULL WHEN ln = 4 THEN start ELSE "end" END AS "end" FROM reads) x) y WHERE problem IS NOT NULL""")(
    lambda r: intervals.validate_bed(r.select(F.when(F.col("ln") != 1, F.col("chrom")).alias("chrom"), (F.col("start") - F.when(F.col("ln") == 2, 5000).otherwise(0)).alias("start"), F.when(F.col("ln") == 4, F.col("start")).when(F.col("ln") != 3, F.col("end")).alias("end"))))
query("variant_query", f"{VK} filter:s", "variants", "SELECT chrom, pos, ref, alt, 'LOW' AS filter FROM variants WHERE side = 'q' AND gq > 5 AND ac >= 20")(
    lambda v: variants.having(_side(v, "q"), "LOW", "AF").where("ac >= 20").withColumn("filter", F.array_join("filter", ";")))
query("source_label", f"{VK} filter:s", "variants", "SELECT chrom, pos, ref, alt, CASE WHEN hp = 0 THEN CASE WHEN gq > 5 THEN 'LOW' ELSE '' END ELSE 'RG1' END AS filter FROM variants WHERE side = 'q' AND hp <> 1")(
    lambda v: variants.labelled(_side(v, "q").withColumn("gt", F.when(F.col("hp") == 0, "./.").when(F.col("hp") == 1, "0/0").otherwise(F.col("gt"))), "RG1").where("gt <> '0/0'").withColumn("filter", F.array_join("filter", ";")))
query("called_only", f"{VK} gt:s", "variants", "SELECT chrom, pos, ref, alt, CASE WHEN ad_ref > 0 THEN '0/1' ELSE '1/1' END AS gt FROM variants WHERE hp > 1")(
    lambda v: variants.called(v.withColumn("gt", F.when(F.col("hp") == 0, "./.").when(F.col("hp") == 1, "0/0").when(F.col("ad_ref") > 0, "0/1").otherwise("1/1"))))

# --- intervals and fetches ------------------------------------------------------------------
query("region_reads", READ, "reads targets", """SELECT a.chrom, a.start, a."end", qname, mapq FROM reads a JOIN targets b ON a.chrom = b.chrom AND a.start < b."end" AND greatest(b.start - 1, 0) < a."end" WHERE b.target_id % 4 = 0""")(
    lambda r, t: reads.region_reads(r, t.where("target_id % 4 = 0")))
query("region_reads_once", READ, "reads targets", """SELECT chrom, start, "end", qname, mapq FROM reads a WHERE EXISTS (SELECT 1 FROM targets b WHERE a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" AND b.target_id % 40 = 0)""")(
    lambda r, t: reads.region_reads(r, t.where("target_id % 40 = 0"), early=False, once=True))
query("complement_new", IV, "reads targets", f"""WITH cut AS (SELECT chrom, start, "end" FROM targets WHERE target_id % 3 = 0),
h AS ({MERGE.format(k="chrom", g=0, t="cut")}),
own AS (SELECT DISTINCT chrom, start, "end" FROM reads WHERE mapq < 20),
b AS (SELECT own.*, unnest(generate_series(own.start, own."end" - 1)) AS p FROM own),
u AS (SELECT b.* FROM b LEFT JOIN h ON h.chrom = b.chrom AND h.start <= b.p AND b.p < h."end" WHERE h.chrom IS NULL),
g AS (SELECT *, p - row_number() OVER (PARTITION BY chrom, start, "end" ORDER BY p) AS k FROM u)
SELECT chrom, min(p) AS start, max(p) + 1 AS "end" FROM g GROUP BY chrom, g.start, g."end", k""")(
    lambda r, t: intervals.complement_new(r.where("mapq < 20").select("chrom", "start", "end").distinct(), t.where("target_id % 3 = 0").select("chrom", "start", "end")))
BLOCKED = """c AS (SELECT r.chrom, r.start, r.qname, r.mapq, list_transform(regexp_extract_all(cigar, '(\\d+)[=XID]', 1), lambda x: CAST(x AS INT)) AS v FROM (SELECT DISTINCT qname, ln, pk, chrom, start, mapq FROM reads) r JOIN cigars g ON g.qname = r.qname AND g.ln = r.ln AND g.pk = r.pk)"""
query("aligned_depth", "chrom:s pos:i depth:i", "reads cigars", f"""WITH {BLOCKED}, p AS (SELECT chrom, unnest(generate_series(start + 1, start + v[1] + v[2] + v[4])) AS pos FROM c WHERE mapq >= 20 UNION ALL SELECT chrom, unnest(generate_series(start + v[1] + v[2] + v[4] + v[5] + 1, start + v[1] + v[2] + v[4] + v[5] + v[6])) FROM c WHERE mapq >= 20)
SELECT chrom, pos, count(*) AS depth FROM p GROUP BY chrom, pos""")(
    lambda r, c: intervals.per_base(intervals.depth_runs(reads.aligned_depth_input(_placed(r, c), 20))))
query("aligned_depth_quality", "chrom:s pos:i depth:i", "reads cigars", f"""WITH {BLOCKED}, b AS (SELECT *, unnest(generate_series(0, v[1] + v[2] + v[4] + v[5] + v[6] - 1)) AS i FROM c WHERE mapq >= 50),
q AS (SELECT chrom, start + i + 1 AS pos, CASE WHEN i < v[1] + v[2] THEN i WHEN i < v[1] + v[2] + v[4] THEN i + v[3] WHEN i < v[1] + v[2] + v[4] + v[5] THEN NULL ELSE i + v[3] - v[5] END AS k, qname FROM b)
SELECT chrom, pos, count(*) AS depth FROM q WHERE k IS NOT NULL AND ((k + 1) * 7 + qname) % 30 + 5 >= 20 GROUP BY chrom, pos""")(
    lambda r, c: intervals.per_base(intervals.depth_runs(reads.aligned_depth_input(_placed(r, c), 50, 20))))


def _placed(r, c):
    quals = F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: (i * 7 + F.col("qname")) % 30 + 5)
    return r.select("qname", "ln", "pk", "chrom", "start", "mapq").distinct().join(c, ["qname", "ln", "pk"]).withColumn("quals", quals)


query("rebased_reads", "chrom:s pos:i mate_pos:i qname:s", "reads", "SELECT 'S' || sk AS chrom, start AS pos, start + ln AS mate_pos, qname || ':RG1' AS qname FROM reads")(
    lambda r: reads.rebased(r.select(F.concat(F.lit("S"), "sk", F.lit(":"), F.col("start") - F.col("start") % 100).alias("contig"), (F.col("start") % 100).alias("pos"), (F.col("start") % 100 + F.col("ln")).alias("mate_pos"), "qname"), "RG1"))

# --- sets ---------------------------------------------------------------------------------------
query("set_difference", "qname:i", "reads", "SELECT DISTINCT qname FROM reads EXCEPT SELECT qname FROM reads WHERE xa = 1")(lambda r: r.select("qname").subtract(r.where("xa = 1").select("qname")))
query("set_intersection", "qname:i", "reads", "SELECT qname FROM reads WHERE strand = '+' INTERSECT SELECT qname FROM reads WHERE strand = '-'")(lambda r: r.where("strand = '+'").select("qname").intersect(r.where("strand = '-'").select("qname")))
query("zip_longest", "place:i x:i y:i", "reads", """WITH g AS (SELECT list(DISTINCT start ORDER BY start) FILTER (WHERE strand = '+') AS a, list(DISTINCT start ORDER BY start) FILTER (WHERE strand = '-') AS b FROM reads WHERE chrom = 'S1')
SELECT i - 1 AS place, a[i] AS x, b[i] AS y FROM (SELECT a, b, unnest(generate_series(1, greatest(len(a), len(b)))) AS i FROM g) z""")(
    lambda r: r.where("chrom = 'S1'").agg(*[F.array_sort(F.collect_set(F.when(F.col("strand") == s, F.col("start")))).alias(n) for s, n in (("+", "x"), ("-", "y"))]).select(F.posexplode(F.arrays_zip("x", "y")).alias("place", "z")).select("place", "z.x", "z.y"))
query("not_null_counts", "rows:i best:i second:i", "reads", "SELECT count(*) AS rows, count(CASE WHEN tag_as > 3 THEN 1 END) AS best, count(CASE WHEN tag_xs > 3 THEN 1 END) AS second FROM reads")(
    lambda r: r.select(F.when(F.col("tag_as") > 3, F.col("tag_as")).alias("a"), F.when(F.col("tag_xs") > 3, F.col("tag_xs")).alias("b")).agg(F.count("*").alias("rows"), F.count("a").alias("best"), F.count("b").alias("second")))
query("summary_numbers", "name:s number:d", "reads", "SELECT 'raw total ' || chrom AS name, count(*) AS number FROM reads GROUP BY chrom")(
    lambda r: reads.summary_numbers(r.groupBy("chrom").agg(F.count("*").alias("n")).select(F.explode(F.array(F.concat_ws("\t", F.lit("SN"), F.concat(F.lit("raw total "), "chrom", F.lit(":")), F.col("n").cast("string")), F.lit("FFQ\t1\t2"))).alias("value"))))

# --- column functions -----------------------------------------------------------------------------
query("compare_loci", "a:i b:i order:i", "reads", """WITH d AS (SELECT DISTINCT chrom, start, "end", qname, mapq FROM reads WHERE mapq >= 60), x AS (SELECT a.qname AS a, b.qname AS b, a.chrom AS ca, b.chrom AS cb, a.start AS sa, a."end" AS ea, b.start AS sb, b."end" AS eb FROM d a JOIN d b ON a.qname + 1 = b.qname)
SELECT a, b, CASE WHEN ca < cb THEN -1 WHEN ca > cb THEN 1 WHEN sa = sb AND ea = eb THEN 0 WHEN ea <= sb THEN -1 WHEN sa >= eb THEN 1 ELSE 2 END AS "order" FROM x""")(
    lambda r: (lambda d: d.alias("x").join(d.alias("y"), F.col("x.qname") + 1 == F.col("y.qname")).select(F.col("x.qname").alias("a"), F.col("y.qname").alias("b"), sc.compare_loci(*[F.col(f"{s}.{c}") for s in "xy" for c in ("chrom", "start", "end")]).alias("order")))(
        r.where("mapq >= 60").select("chrom", "start", "end", "qname", "mapq").distinct()))
query("aligned_blocks", "qname:i ln:i pk:i s:i e:i", "cigars", VEC + " SELECT qname, ln, pk, 0 AS s, v[1] AS e FROM n UNION ALL SELECT qname, ln, pk, v[1], v[1] + v[2] FROM n UNION ALL SELECT qname, ln, pk, v[1] + v[2], v[1] + v[2] + v[4] FROM n UNION ALL SELECT qname, ln, pk, v[1] + v[2] + v[4] + v[5], v[1] + v[2] + v[4] + v[5] + v[6] FROM n")(
    lambda c: c.select("qname", "ln", "pk", F.explode(sc.aligned_blocks(sc.cigar_ops(F.col("cigar")), F.lit(0))).alias("b")).select("qname", "ln", "pk", "b.s", "b.e"))
query("soft_clipped", "qname:i ln:i pk:i clipped:i", "cigars", "SELECT qname, ln, pk, pk % 7 + ln AS clipped FROM cigars")(
    lambda c: c.select("qname", "ln", "pk", sc.soft_clipped(sc.cigar_ops(F.concat((F.col("pk") % 7).cast("string"), F.lit("S"), "cigar", F.col("ln").cast("string"), F.lit("S")))).alias("clipped")))
ARRAYS = "array_to_string({x}, ',')"
HAPVEC = "concat(repeat('1,', v[1]), repeat('-4,', v[2]), 4 * v[3], ',', repeat('1,', v[4] - 1), repeat('-6,', v[5]), repeat('1,', v[6]))"
query("hapvec_whole", "qname:i ln:i pk:i v:s", "cigars", VEC + f" SELECT qname, ln, pk, {HAPVEC} AS v FROM n")(
    lambda c: c.select("qname", "ln", "pk", sc.read_vector(sc.cigar_ops(F.col("cigar"))).alias("v")).withColumn("v", F.concat(F.array_join("v", ","), F.lit(","))))
query("hapvec_unread_base", "qname:i v:s", "cigars", "SELECT DISTINCT qname, CASE WHEN qname % 2 = 0 THEN '1,1,1,-4,-4,1,' ELSE '1,-4,1,-4,-4,1,' END AS v FROM cigars")(
    lambda c: c.select("qname").distinct().select("qname", F.concat(F.array_join(sc.read_vector(sc.cigar_ops(F.lit("2S1=1X1=2X1=")), F.when(F.col("qname") % 2 == 0, "ACGNANNT").otherwise("NNNANNNT")), ","), F.lit(",")).alias("v")))
query("refqidx_whole", "qname:i ln:i pk:i v:s", "cigars", VEC + """ SELECT qname, ln, pk, array_to_string(list_concat(list_concat(range(0, v[1] + v[2]), range(v[1] + v[2] + v[3], v[1] + v[2] + v[3] + v[4])), list_concat(list_transform(range(0, v[5]), lambda x: -1), range(v[1] + v[2] + v[3] + v[4], v[1] + v[2] + v[3] + v[4] + v[6]))), ',') AS v FROM n""")(
    lambda c: c.select("qname", "ln", "pk", F.array_join(sc.query_index(sc.cigar_ops(F.col("cigar"))), ",").alias("v")))
query("errvec_whole", "qname:i ln:i pk:i v:s", "cigars", VEC + """ SELECT qname, ln, pk, concat(array_to_string(list_transform(range(0, v[1] + v[2] - 1), lambda i: (i * 7 + qname) % 30 + 5), ','), ',0,', array_to_string(list_transform(range(v[1] + v[2] + v[3], v[1] + v[2] + v[3] + v[4]), lambda i: (i * 7 + qname) % 30 + 5), ','), ',', repeat('0,', v[5]), array_to_string(list_transform(range(v[1] + v[2] + v[3] + v[4], v[1] + v[2] + v[3] + v[4] + v[6]), lambda i: (i * 7 + qname) % 30 + 5), ',')) AS v FROM n""")(
    lambda c: c.select("qname", "ln", "pk", sc.error_vector(sc.cigar_ops(F.col("cigar")), F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: (i * 7 + F.col("qname")) % 30 + 5)).alias("v")).withColumn("v", F.array_join(F.transform("v", lambda p: F.when(p == 0, "0").otherwise(F.round(-10 * F.log10(p)).cast("int").cast("string"))), ",")))
query("encoded_bases", "qname:i codes:s alike:b", "reads", """SELECT DISTINCT qname, ln, CASE ln % 3 WHEN 0 THEN '0,1,2,3,4' WHEN 1 THEN '4,1,2,3,4' ELSE '0,1,2,2,4' END AS codes, ln % 3 <> 2 AS alike FROM reads""")(
    lambda r: r.select("qname", "ln").distinct().select("qname", sc.encoded(F.when(F.col("ln") % 3 == 0, "ATCGN").when(F.col("ln") % 3 == 1, "xtcgR").otherwise("aTCCN")).alias("c")).select("qname", F.array_join("c", ",").alias("codes"), sc.equal_but_n(F.col("c"), sc.encoded(F.lit("ATCGA"))).alias("alike")))
query("interval_sequence", "qname:i ln:i pk:i part:s", "cigars", VEC + """, d AS (SELECT *, v[1] + v[2] + v[4] AS gap, v[1] + v[2] + v[3] + v[4] AS q FROM n)
SELECT qname, ln, pk, CASE ln % 3 WHEN 0 THEN substr(repeat('0123', 60), CASE WHEN v[4] = 1 THEN v[1] + v[2] ELSE q - 1 END, CASE WHEN v[4] = 1 THEN v[3] + 2 ELSE 2 END) WHEN 1 THEN '' ELSE substr(repeat('0123', 60), q + 1, 1) END AS part FROM d""")(
    lambda c: (lambda ops, n: c.select("qname", "ln", "pk", F.array_join(sc.interval_sequence(
        F.transform(F.sequence(F.lit(0), F.lit(239)), lambda i: i % 4), sc.query_index(ops),
        F.when(F.col("ln") % 3 == 0, n - 2).otherwise(n), F.when(F.col("ln") % 3 == 2, n + _deleted(ops) + 1).otherwise(n + _deleted(ops))), "").alias("part")))(sc.cigar_ops(F.col("cigar")), _before_gap(sc.cigar_ops(F.col("cigar")))))


def _deleted(ops):
    return F.element_at(F.filter(ops, lambda x: x["op"] == "D"), 1)["len"]


def _before_gap(ops):
    return F.get(ops, 0)["len"] + F.get(ops, 1)["len"] + F.get(ops, 3)["len"]


query("node_parse", "chrom:s start:i end:i strand:s", "reads", 'SELECT chrom, start, "end", strand FROM reads')(
    lambda r: r.select(sc.parse_node(F.concat(F.lit("('"), "chrom", F.lit("', "), "start", F.lit(", "), "end", F.lit(", '"), "strand", F.lit("')"))).alias("n")).select("n.chrom", "n.start", "n.end", "n.strand"))
query("array_helpers", "qname:i ln:i pk:i places:s votes:b veto:b has:b", "cigars", VEC + """ SELECT qname, ln, pk, array_to_string(list_concat(range(v[1], v[1] + v[2] + 1), range(v[1] + v[2] + v[4], v[1] + v[2] + v[4] + v[5])), ',') AS places, ln % 3 = 1 AS votes, ln % 3 = 2 AS veto, qname % 2 = 0 AS has FROM n""")(
    lambda c: c.select("qname", "ln", "pk", sc.read_vector(sc.cigar_ops(F.col("cigar"))).alias("v"), F.when(F.col("ln") % 3 == 1, F.array(F.lit(0), F.lit(1))).when(F.col("ln") % 3 == 2, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(0), F.lit(0))).alias("t"))
    .select("qname", "ln", "pk", F.array_join(sc.differing(F.col("v"), F.array_repeat(F.lit(1), F.size("v"))), ",").alias("places"), sc.verdict(F.col("t")).alias("votes"), sc.vetoed(F.col("t")).alias("veto"), F.array_contains(F.array(F.lit(0)), (F.col("qname") % 2).cast("int")).alias("has")))
query("overlap_fractions", "a:i b:i most:d", "reads", """WITH d AS (SELECT DISTINCT chrom, start, "end", qname FROM reads WHERE mapq >= 60) SELECT a.qname AS a, b.qname AS b, (least(a."end", b."end") - greatest(a.start, b.start)) * 1.0 / least(a."end" - a.start, b."end" - b.start) AS most FROM d a JOIN d b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" AND a.qname < b.qname""")(
    lambda r: (lambda d: intervals.overlaps(d, d).where("qname < qname_b").select(F.col("qname").alias("a"), F.col("qname_b").alias("b"), sc.overlap_fraction(F.col("overlap_len"), F.col("end") - F.col("start"), F.col("end_b") - F.col("start_b")).alias("most")))(r.where("mapq >= 60").select("chrom", "start", "end", "qname").distinct()))
query("same_pairs", "chr_1:s start_1:i chr_2:s start_2:i rate:i same:i", "sd_pairs", """WITH p AS (SELECT *, strand1 = strand2 AS straight FROM sd_pairs),
u AS (SELECT chr_1, start_1, end_1, chr_2, start_2, end_2, straight FROM p UNION ALL SELECT chr_2, start_2, end_2, chr_1, start_1, end_1, straight FROM p WHERE NOT (chr_1 = chr_2 AND start_1 = start_2 AND end_1 = end_2)),
c AS (SELECT chr_1, start_1, end_1, chr_2, start_2, end_2, straight, count(*) AS n FROM u GROUP BY ALL)
SELECT p.chr_1, p.start_1, p.chr_2, p.start_2, p.rate, c.n AS same FROM p JOIN c USING (chr_1, start_1, end_1, chr_2, start_2, end_2, straight)""", given="pair_rows")(
    lambda p: graphs.repeats(p).select("chr_1", "start_1", "chr_2", "start_2", "rate", "same"))
query("umbrella_pairs", "target_id:i n:i", "sd_pairs targets", f"""WITH w AS ({WO}), d AS (SELECT DISTINCT target_id, chr_1, start_1, end_1, chr_2, start_2, end_2, strand1, strand2, overlap_len FROM w)
SELECT x.target_id, count(*) AS n FROM d x JOIN d y ON x.target_id = y.target_id AND x.chr_1 = y.chr_1 AND x.chr_2 = y.chr_2 AND least(x.end_1, y.end_1) - greatest(x.start_1, y.start_1) >= 0.95 * (y.end_1 - y.start_1) AND least(x.end_2, y.end_2) - greatest(x.start_2, y.start_2) >= 0.95 * (y.end_2 - y.start_2)
 AND (x.strand1 = x.strand2) = (y.strand1 = y.strand2) AND x.overlap_len <= y.overlap_len GROUP BY x.target_id""", given="pair_rows targets")(
    lambda p, t: graphs.umbrella_counts(_on_target_groups(p, t), "target_id"))
query("variant_trim", "pos:i ref:s alt:s", "variants", "SELECT DISTINCT CASE WHEN hp = 0 THEN pos + 2 WHEN hp = 1 THEN pos + 1 ELSE pos END AS pos, CASE WHEN hp = 0 THEN ref WHEN hp = 1 THEN 'GTT' ELSE ref END AS ref, CASE WHEN hp = 0 THEN alt WHEN hp = 1 THEN 'G' ELSE alt END AS alt FROM variants WHERE ref <> alt")(
    lambda v: v.where("ref <> alt").select(sc.trimmed_variant(F.col("pos"), *[F.when(F.col("hp") == 0, F.concat(F.lit("CA"), c, F.lit("GG"))).when(F.col("hp") == 1, F.lit(x)).otherwise(F.col(c)) for c, x in (("ref", "AGTTC"), ("alt", "AGC"))]).alias("t")).select("t.pos", "t.ref", "t.alt").distinct())

# --- statistics and choices ---------------------------------------------------------------------
query("genotype_types", f"{VK} type:s", "variants", "SELECT chrom, pos, ref, alt, CASE WHEN ad_ref + ad_alt = 0 OR hp = 4 THEN 'miss' WHEN ad_ref > 0 AND ad_alt = 0 THEN '0' ELSE '0/1' END AS type FROM variants WHERE side = 'q'")(
    lambda v: v.where("side = 'q'").withColumn("type", variants.genotype(F.when(F.col("hp") != 4, F.col("ad_ref") + F.col("ad_alt")), F.col("ad_ref"), F.col("ad_alt"), F.lit("0/1"))))
query("pick_called", "chrom:s pos:i caller:s gt:i", "variants", """WITH c AS (SELECT chrom, pos, CASE WHEN side = 'q' THEN 'GATK' ELSE 'other' END AS caller, max(hp % 3) AS gt FROM variants GROUP BY 1, 2, 3),
t AS (SELECT *, min(gt) OVER w = max(gt) OVER w OR min(gt) OVER w > 0 AS alike FROM c WINDOW w AS (PARTITION BY chrom, pos))
SELECT chrom, pos, caller, gt FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY CASE WHEN alike AND caller = 'GATK' THEN 0 ELSE 1 END, gt DESC, caller) AS n FROM t) z WHERE n = 1""")(
    lambda v: variants.pick_called(v.groupBy("chrom", "pos", F.when(F.col("side") == "q", "GATK").otherwise("other").alias("caller")).agg(F.max(F.col("hp") % 3).alias("gt"))))
query("best_scores", "chrom:s start:i hap:s best:d", "reads", "SELECT chrom, start // 120 * 120 AS start, chrom || ':' || (start // 120 * 120) || ':' || (pk % 7) AS hap, greatest(0, coalesce(max(CASE WHEN ln > 2 THEN tag_as - tag_xs END), 0)) AS best FROM reads GROUP BY 1, 2, 3")(
    lambda r: (lambda d: reads.best_scores(d.select("chrom", "start", "hap").distinct(), d.where("ln > 2").select("hap", (F.col("tag_as") - F.col("tag_xs")).cast("double").alias("score"))))(
        r.select("chrom", (F.floor(F.col("start") / 120) * 120).alias("start"), "ln", "tag_as", "tag_xs", "pk").withColumn("hap", F.concat_ws(":", "chrom", F.col("start").cast("string"), (F.col("pk") % 7).cast("string")))))
query("small_gate", "chrom:s start:i hap:i small:b", "reads", f"WITH {REC} SELECT chrom, start, hap, count(*) OVER (PARTITION BY chrom, start) <= 2 AS small FROM rec")(lambda r: reads.small_gate(_records(r), ["chrom", "start"]))
query("group_sums", "label:s size:i intervals:i chroms:i", "targets", """SELECT 'RG' || (target_id % 9) AS label, sum("end" - start) AS size, count(DISTINCT start) AS intervals, count(DISTINCT chrom) AS chroms FROM targets GROUP BY 1""")(
    lambda t: t.groupBy(F.concat(F.lit("RG"), F.col("target_id") % 9).alias("label")).agg(F.sum(F.col("end") - F.col("start")).alias("size"), F.countDistinct("start").alias("intervals"), F.countDistinct("chrom").alias("chroms")))
query("members_rough", VK, "variants", f"WITH {SIDES} SELECT q.chrom, q.pos, q.ref, q.alt FROM q SEMI JOIN r ON q.chrom = r.chrom AND q.pos = r.pos AND q.ref = r.ref AND q.alt = r.alt")(
    lambda v: variants.members(_side(v, "q"), _side(v, "r")))
query("hap_list", "chrom:s start:i names:s", "reads", "SELECT chrom, start // 120 * 120 AS start, string_agg(DISTINCT CAST(pk % 7 AS VARCHAR), ';' ORDER BY CAST(pk % 7 AS VARCHAR)) AS names FROM reads GROUP BY 1, 2")(
    lambda r: r.groupBy("chrom", (F.floor(F.col("start") / 120) * 120).alias("start")).agg(F.array_join(F.array_sort(F.collect_set((F.col("pk") % 7).cast("string"))), ";").alias("names")))
query("counts_distinct", "sites:i names:i", "variants", "SELECT count(DISTINCT chrom || ':' || pos) AS sites, count(DISTINCT ref || alt) AS names FROM variants")(
    lambda v: v.agg(F.countDistinct(F.concat_ws(":", "chrom", "pos")).alias("sites"), F.countDistinct(F.concat("ref", "alt")).alias("names")))
