"""Queries that write the tables as text lines of each format and parse them
again; the SQL says what must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import variants
from ..sources import formats
from .queries import VK, query

query("bed_roundtrip", "chrom:s start:i end:i rel_start:i rel_end:i strand:s tag:s", "reads", """SELECT chrom, start, "end", CASE WHEN pk % 3 > 0 THEN ln END AS rel_start, qty AS rel_end, strand, CASE WHEN xa = 1 THEN 'FC:RG' || (pk % 5) || '_0' END AS tag FROM reads""")(
    lambda r: formats.bed_records(formats.bed_lines(r.select("chrom", "start", "end", F.when(F.col("pk") % 3 > 0, F.col("ln")).alias("rel_start"), F.col("qty").alias("rel_end"), "strand", F.when(F.col("xa") == 1, F.concat(F.lit("FC:RG"), F.col("pk") % 5, F.lit("_0"))).alias("tag"))), 7))
query("vcf_roundtrip", f"{VK} qual:d filter:s ac:s", "variants", """SELECT DISTINCT chrom, pos, ref, alt || ',*' AS alt, gq / 2.0 AS qual, CASE WHEN hp > 2 THEN 'LOW;AF' ELSE '' END AS filter, CAST(ac AS VARCHAR) AS ac FROM variants""")(
    lambda v: formats.vcf_records(formats.vcf_document(v.select("chrom", "pos", "ref", F.array("alt", F.lit("*")).alias("alts"), (F.col("gq") / 2).alias("qual"), F.when(F.col("hp") > 2, F.array(F.lit("LOW"), F.lit("AF"))).otherwise(F.expr("cast(array() as array<string>)")).alias("filter"), F.create_map(F.lit("AC"), F.col("ac").cast("string")).alias("info")))
                                  .select("value")).select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alt"), "qual", F.array_join("filter", ";").alias("filter"), F.col("info")["AC"].alias("ac")))
HEADERS = """h AS (SELECT DISTINCT 1 AS k, 'FILTER' AS kind, 'F' || (pk % 7) AS id, '##FILTER=<ID=F' || (pk % 7) || ',Description="first">' AS text FROM reads
UNION ALL SELECT DISTINCT 2, CASE WHEN pk % 2 = 0 THEN 'FILTER' ELSE 'INFO' END, 'F' || (pk % 11), '##' || CASE WHEN pk % 2 = 0 THEN 'FILTER' ELSE 'INFO' END || '=<ID=F' || (pk % 11) || ',Description="second">' FROM reads)"""
query("vcf_headers", "kind:s id:s text:s", "reads", f"WITH {HEADERS} SELECT kind, id, arg_min(text, k) AS text FROM h GROUP BY kind, id")(
    lambda r: variants.merge_headers(*[formats.vcf_headers(formats.vcf_document(
        r.limit(0).select("chrom", F.col("start").alias("pos"), F.lit("A").alias("ref"), F.array(F.lit("C")).alias("alts"), F.array(F.lit("x")).alias("filter")),
        r.select(kind.alias("kind"), F.concat(F.lit("##"), kind, F.lit("=<ID=F"), F.col("pk") % n, F.lit(f',Description="{said}">')).alias("text")).distinct()).where("part = 1").select("value"))
        for kind, n, said in ((F.lit("FILTER"), 7, "first"), (F.when(F.col("pk") % 2 == 0, "FILTER").otherwise("INFO"), 11, "second"))]))
query("sam_roundtrip", "qname:s flag:i chrom:s start:i end:i mapq:i cigar:s mate_chrom:s quals:s tag_as:s", "reads cigars", """SELECT CAST(r.qname AS VARCHAR) AS qname, flag, chrom, start, start + CAST(l[1] AS INT) + CAST(l[2] AS INT) + CAST(l[4] AS INT) + CAST(l[5] AS INT) + CAST(l[6] AS INT) AS "end", mapq, cigar,
  CASE WHEN xa = 1 THEN chrom ELSE 'S0' END AS mate_chrom, '5,40,' || qty AS quals, CAST(tag_as AS VARCHAR) AS tag_as
FROM reads r JOIN (SELECT *, regexp_extract_all(cigar, '(\\d+)[=XID]', 1) AS l FROM cigars) c ON c.qname = r.qname AND c.ln = r.ln AND c.pk = r.pk""")(
    lambda r, c: formats.sam_records(formats.sam_lines(r.join(c, ["qname", "ln", "pk"]).select("qname", "flag", "chrom", "start", "mapq", "cigar", F.when(F.col("xa") == 1, F.col("chrom")).otherwise("S0").alias("mate_chrom"), F.array(F.lit(5), F.lit(40), F.col("qty")).alias("quals"), F.create_map(F.lit("AS"), F.col("tag_as").cast("string")).alias("tags"))))
    .withColumns({"quals": F.array_join(F.transform("quals", lambda q: q.cast("string")), ","), "tag_as": F.col("tags")["AS"]}))
SEQ = "repeat('ACGTTGCAAC', 260)"


def _genome(g):
    whole = g.select("chrom", F.repeat(F.lit("ACGTTGCAAC"), 260).alias("seq"))
    return formats.fasta_records(formats.fasta_blocks(whole).select(F.substring("value", 2, 10_000).alias("value")))


for _name, _reverse in (("fasta_regions", False), ("fasta_regions_reverse", True)):
    _sql = "substr({s}, start + 1, \"end\" - start)".format(s=SEQ)
    query(_name, "chrom:s start:i end:i seq:s", "targets genome", f"""SELECT t.chrom, start, "end", {f"reverse(translate({_sql}, 'ACGT', 'TGCA'))" if _reverse else _sql} AS seq FROM targets t JOIN genome g ON g.chrom = t.chrom""")(
        lambda t, g, rev=_reverse: formats.fasta_region(_genome(g), t, rev))
query("fasta_changed", "chrom:s seq:s", "genome", "SELECT chrom, CASE WHEN s % 3 = 0 THEN 'NN' ELSE 'ACGT' END AS seq FROM (SELECT chrom, CAST(substr(chrom, 2) AS INT) AS s FROM genome) a WHERE s % 3 = 0 OR s % 5 = 0")(
    lambda g: (lambda n: formats.changed(g.where(n % 5 != 0).select("chrom", F.lit("ACGT").alias("seq")), g.select("chrom", F.when(n % 3 == 0, "NN").otherwise("ACGT").alias("seq"))))(F.substring("chrom", 2, 9).cast("int")))
query("fastq_mate", "qname:s line:i value:s", "reads", """SELECT CAST(qname AS VARCHAR) AS qname, i AS line, CASE i WHEN 0 THEN '@' || qname WHEN 1 THEN repeat('AC', qty) WHEN 2 THEN '+' ELSE repeat('I', 2 * qty) END AS value FROM (SELECT qname, CAST(qty AS BIGINT) AS qty, unnest([0, 1, 2, 3]) AS i FROM reads WHERE (flag & 64) <> 0) x""")(
    lambda r: formats.fastq_lines(r.select("qname", "flag", F.repeat(F.lit("AC"), F.col("qty")).alias("seq"), F.repeat(F.lit("I"), 2 * F.col("qty")).alias("qual")), 1))
NODES = """n AS (SELECT DISTINCT chrom || '<&"' || start || '">' AS id, chrom, start, "end", strand FROM reads WHERE qty <= 25)"""


def _nodes(r):
    return r.where("qty <= 25").select(F.concat("chrom", F.lit('<&"'), "start", F.lit('">')).alias("id"), "chrom", "start", "end", "strand").distinct()


def _document(r):
    n = _nodes(r)
    edges = n.select(F.col("id").alias("a"), F.concat(F.lit("to & "), "chrom").alias("b"), F.lit("a<b").alias("type"), (F.col("start") / 4).alias("weight"))
    return formats.graphml_document(n, edges)


query("graphml_nodes", "id:s chrom:s start:i end:i strand:s", "reads", f"WITH {NODES} SELECT * FROM n")(lambda r: formats.read_graphml_nodes(_document(r)))
query("graphml_edges", "a:s b:s type:s weight:d", "reads", f"WITH {NODES} SELECT id AS a, 'to & ' || chrom AS b, 'a<b' AS type, start / 4.0 AS weight FROM n")(lambda r: formats.read_graphml(_document(r)))


def _paf_lines(r):
    """Lines of twelve fields, and short ones that don't count."""
    order, zero = F.struct("ln", "pk", "chrom", "start", "qty", "tag_as").alias("o"), F.lit("0")
    whole = F.concat_ws("\t", F.col("qname").cast("string"), zero, zero, zero, "strand", "chrom", zero, zero, zero, F.col("tag_as").cast("string"), F.col("qty").cast("string"), zero)
    return r.select(F.when(F.col("xa") == 0, whole).otherwise(F.concat_ws("\t", F.col("qname").cast("string"), zero)).alias("value"), order)


query("paf_first", "qname:s tname:s strand:s similarity:d", "reads", """WITH p AS (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY ln, pk, chrom, start, qty, tag_as) AS n FROM reads WHERE xa = 0) SELECT CAST(qname AS VARCHAR) AS qname, chrom AS tname, strand, tag_as * 1.0 / qty AS similarity FROM p WHERE n = 1""")(
    lambda r: formats.first_paf(formats.paf_records(_paf_lines(r)), "o"))
query("depth_lines", "chrom:s pos:i depth:i", "reads", "SELECT DISTINCT chrom, start AS pos, qty AS depth FROM reads")(
    lambda r: formats.depth_records(formats.bed_lines(r.select("chrom", "start", "qty").distinct())))
query("fai_lines", "chrom:s start:i length:i", "genome", "SELECT chrom, 0 AS start, length FROM genome")(
    lambda g: formats.fai_records(formats.bed_lines(g.select("chrom", "length", F.lit(7), F.lit(60), F.lit(61)))))
query("mpileup_lines", "chrom:s pos:i base:s ad:i dp:i", "reads", """WITH l AS (SELECT DISTINCT chrom, start, qty, ln, xa FROM reads),
u AS (SELECT chrom, start - 1 AS pos, 'A' AS base, qty AS ad, qty + CASE WHEN xa = 1 THEN ln ELSE 0 END AS dp FROM l UNION ALL SELECT chrom, start - 1, 'C', ln, qty + ln FROM l WHERE xa = 1) SELECT * FROM u""")(
    lambda r: formats.mpileup_records(r.select("chrom", "start", "qty", "ln", "xa").distinct().select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.lit("A"), F.when(F.col("xa") == 1, "C,<*>").otherwise("<*>"), F.when(F.col("xa") == 1, F.concat_ws(",", "qty", "ln", F.lit("."))).otherwise(F.concat_ws(",", "qty", F.lit(".")))).alias("value"))))
query("incore_csv", "label:s sub:i size:i", "targets", """SELECT 'RG' || (target_id % 9) AS label, CASE WHEN target_id % 4 > 0 THEN target_id % 3 END AS sub, "end" - start AS size FROM targets""")(
    lambda t: formats.csv_records(t.select(F.concat_ws(",", F.concat(F.lit("RG"), F.col("target_id") % 9), F.when(F.col("target_id") % 4 > 0, (F.col("target_id") % 3).cast("string")).otherwise("NaN"), (F.col("end") - F.col("start")).cast("string")).alias("value")), "label string, sub int, size int"))
query("group_dirs", "name:s", "targets", "SELECT DISTINCT 'RG' || (target_id % 40) AS name FROM targets WHERE target_id % 3 = 0")(
    lambda t: formats.read_group_dirs(t.select(F.when(F.col("target_id") % 3 == 0, F.concat(F.lit("RG"), F.col("target_id") % 40)).when(F.col("target_id") % 3 == 1, F.concat(F.lit("xRG"), F.col("target_id") % 40)).otherwise(F.concat(F.lit("RG"), F.col("target_id") % 40, F.lit("_all"))).alias("name")).distinct()))
query("tsv_lines", "line:i value:s", "targets", """SELECT 0 AS line, 'chrom' || chr(9) || 'start' || chr(9) || 'note' AS value UNION ALL SELECT 1, chrom || chr(9) || start || chr(9) || CASE WHEN target_id % 2 = 0 THEN 'x' ELSE '' END FROM targets""")(
    lambda t: formats.tsv_lines(t.select("chrom", "start", F.when(F.col("target_id") % 2 == 0, "x").alias("note"))))
