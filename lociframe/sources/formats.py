"""Readers and writers of the text formats: BED, FAI, depth, mpileup, PAF, VCF,
SAM, FASTA, FASTQ, GraphML. Each format is a pair of functions between rows and
text lines (a DataFrame with the column `value`); reading and writing paths goes
through Spark's own sources, so any path that Spark can open works, and nothing
is parsed on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import cigar_ops, reference_length, reverse_complement

BED = ["chrom string", "start int", "end int", "rel_start string", "rel_end string", "strand string", "tag string"]


def bed_records(lines: DataFrame, columns: int = 3) -> DataFrame:
    """The first `columns` columns of lines that are no comments; '.' is null."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    known = lambda c: F.when(c != ".", c)
    out = []
    for i, spec in enumerate(BED[:columns]):
        name, kind = spec.split()
        out.append(known(F.get(f, i)).cast("int" if kind == "int" or name.startswith("rel_") else "string").alias(name))
    return rows.select(*out)


def bed_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in df.columns]).alias("value"))


def read_bed(spark: SparkSession, path: str, columns: int = 3) -> DataFrame:
    return bed_records(spark.read.text(path), columns)


def bed_of(spark: SparkSession, text: str) -> DataFrame:
    """Intervals from lines of text in memory."""
    rows = [line.split("\t")[:3] for line in text.splitlines() if line.strip()]
    return spark.createDataFrame([(c, int(s), int(e)) for c, s, e in rows], "chrom string, start int, end int")


def write_bed(df: DataFrame, path: str) -> None:
    bed_lines(df).write.mode("overwrite").text(path)


def tsv_lines(df: DataFrame) -> DataFrame:
    """line (the header is 0 and has no order else) and value."""
    head = df.sparkSession.range(1).select(F.lit(0).alias("line"), F.lit("\t".join(df.columns)).alias("value"))
    return head.unionByName(df.select(F.lit(1).alias("line"), F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value")))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).mode("overwrite").csv(path)


def fai_records(lines: DataFrame) -> DataFrame:
    f = F.split("value", "\t")
    return lines.where(F.size(f) >= 2).select(F.get(f, 0).alias("chrom"), F.lit(0).alias("start"), F.get(f, 1).cast("long").alias("length"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    return fai_records(spark.read.text(path))


def depth_records(lines: DataFrame) -> DataFrame:
    f = F.split("value", "\t")
    return lines.where(F.size(f) >= 3).select(F.get(f, 0).alias("chrom"), F.get(f, 1).cast("int").alias("pos"), F.get(f, 2).cast("int").alias("depth"))


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    return depth_records(spark.read.text(path))


def mpileup_records(lines: DataFrame) -> DataFrame:
    """chrom, pos (0-based), base, ad, dp of lines of chrom, pos, ref, alts and
    allele depths. The reference base counts as an allele; an empty or <*>
    alternative is none; dp is the sum of the depths that are known."""
    f = F.split("value", "\t")
    rows = lines.where(F.size(f) >= 5).select(F.get(f, 0).alias("chrom"), (F.get(f, 1).cast("int") - 1).alias("pos"), F.concat(F.array(F.get(f, 2)), F.split(F.get(f, 3), ",")).alias("bases"), F.transform(F.split(F.get(f, 4), ","), lambda x: x.try_cast("int")).alias("ads"))
    dp = F.aggregate(F.filter("ads", lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x)
    flat = rows.select("chrom", "pos", dp.alias("dp"), F.explode(F.arrays_zip("bases", "ads")).alias("x"))
    return flat.select("chrom", "pos", F.col("x.bases").alias("base"), F.col("x.ads").alias("ad"), "dp").where("base <> '' and base <> '<*>' and ad is not null")


def csv_records(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of CSV texts (column value); NaN is null."""
    return lines.select(F.from_csv("value", schema, {"nullValue": "NaN"}).alias("r")).select("r.*")


def paf_records(lines: DataFrame) -> DataFrame:
    """Lines of at least 12 fields with similarity = matches / aligned length."""
    f = F.split("value", "\t")
    return lines.where(F.size(f) >= 12).select(F.get(f, 0).alias("qname"), F.get(f, 5).alias("tname"), F.get(f, 4).alias("strand"), F.get(f, 9).cast("int").alias("matches"), F.get(f, 10).cast("int").alias("aligned"), F.try_divide(F.get(f, 9).cast("double"), F.get(f, 10).cast("double")).alias("similarity"), *[c for c in lines.columns if c != "value"])


def first_paf(records: DataFrame, order: str) -> DataFrame:
    """Of each query the first record, by the column `order`."""
    from pyspark.sql import Window

    return records.withColumn("__n", F.row_number().over(Window.partitionBy("qname").orderBy(order))).where("__n = 1").drop("__n")


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    return paf_records(spark.read.text(path))


def vcf_records(lines: DataFrame) -> DataFrame:
    """chrom, pos, id, ref, alts, qual, filter, info (map), format, samples."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    dot = lambda c: F.when(c != ".", c)
    flags = F.map_from_entries(F.transform(F.split(F.get(f, 7), ";"), lambda x: F.struct(F.split(x, "=")[0].alias("k"), F.element_at(F.split(x, "=", 2), -1).alias("v"))))
    return rows.select(F.get(f, 0).alias("chrom"), F.get(f, 1).try_cast("int").alias("pos"), dot(F.get(f, 2)).alias("id"), F.get(f, 3).alias("ref"), F.split(F.get(f, 4), ",").alias("alts"), dot(F.get(f, 5)).try_cast("double").alias("qual"),
                       F.filter(F.split(F.get(f, 6), ";"), lambda x: ~x.isin(".", "PASS")).alias("filter"), F.when(F.get(f, 7) == ".", F.expr("map()").cast("map<string,string>")).otherwise(flags).alias("info"),
                       F.get(f, 8).alias("format"), F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0))).alias("samples"))


def read_vcf(spark: SparkSession, path: str, contig: str | None = None) -> DataFrame:
    """contig: only its records; others are dropped before they are split."""
    lines = spark.read.text(path)
    return vcf_records(lines.where(F.col("value").startswith(f"{contig}\t")) if contig else lines)


def vcf_headers(lines: DataFrame) -> DataFrame:
    """kind, id, text of the ## lines."""
    rows = lines.where(F.col("value").startswith("##"))
    return rows.select(F.regexp_extract("value", r"^##(\w+)=", 1).alias("kind"), F.regexp_extract("value", r"<ID=([^,>]+)", 1).alias("id"), F.col("value").alias("text"))


def read_vcf_header(spark: SparkSession, path: str) -> DataFrame:
    return vcf_headers(spark.read.text(path))


def vcf_lines(df: DataFrame) -> DataFrame:
    """Text lines of records (chrom, pos, ref, alts, filter; others optional)."""
    have = set(df.columns)
    col = lambda c, kind="string": F.coalesce(F.col(c).cast(kind), F.lit(".")) if c in have else F.lit(".")
    info = F.when(F.size("info") > 0, F.array_join(F.transform(F.array_sort(F.map_keys("info")), lambda k: F.concat(k, F.lit("="), F.col("info")[k])), ";")).otherwise(".") if "info" in have else F.lit(".")
    status = F.when(F.size("filter") > 0, F.array_join("filter", ";")).otherwise("PASS")
    return df.select("chrom", "pos", F.concat_ws("\t", "chrom", F.col("pos").cast("string"), col("id"), "ref", F.array_join("alts", ","), col("qual"), status, info).alias("value"))


#: The first line of a file and its columns.
VCF_FIRST, VCF_COLUMNS = "##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"


def vcf_document(df: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """part, chrom, pos, value: the lines of a file, in this order. The header
    (kind, id, text) is a row a record kind, and so small; exact repeats of
    records are dropped."""
    spark = df.sparkSession
    none = lambda k: (F.lit(k).alias("part"), F.lit("").alias("chrom"), F.lit(0).alias("pos"))
    out = spark.range(1).select(*none(0), F.lit(VCF_FIRST).alias("value"))
    if headers is not None:
        out = out.unionByName(headers.where(F.col("kind") != "fileformat").select(*none(1), F.col("text").alias("value")))
    out = out.unionByName(spark.range(1).select(*none(2), F.lit(VCF_COLUMNS).alias("value")))
    return out.unionByName(vcf_lines(df).distinct().select(F.lit(3).alias("part"), "chrom", "pos", "value"))


def write_vcf(df: DataFrame, path: str, headers: DataFrame | None = None) -> None:
    """A folder whose part files, one after the other by name, are the file:
    header first, then records sorted by place."""
    lines = vcf_document(df, headers)
    lines.repartitionByRange("part", "chrom", "pos").sortWithinPartitions("part", "chrom", "pos", "value").select("value").write.mode("overwrite").text(path)


def sam_records(lines: DataFrame) -> DataFrame:
    """qname, flag, chrom, start (0-based), end, mapq, cigar, mate_chrom, tlen,
    seq, quals, tags of alignment lines."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("@") & (F.size(f) >= 11))
    start = F.get(f, 3).cast("int") - 1
    quals = F.transform(F.filter(F.split(F.get(f, 10), ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
    tags = F.map_from_entries(F.transform(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))), lambda x: F.struct(x.substr(1, 2).alias("k"), x.substr(F.lit(6), F.length(x)).alias("v"))))
    return rows.select(F.get(f, 0).alias("qname"), F.get(f, 1).cast("int").alias("flag"), F.get(f, 2).alias("chrom"), start.alias("start"), (start + reference_length(cigar_ops(F.get(f, 5)))).alias("end"), F.get(f, 4).cast("int").alias("mapq"),
                       F.get(f, 5).alias("cigar"), F.when(F.get(f, 6) == "=", F.get(f, 2)).otherwise(F.get(f, 6)).alias("mate_chrom"), F.get(f, 8).cast("int").alias("tlen"), F.get(f, 9).alias("seq"), quals.alias("quals"), tags.alias("tags"))


def sam_lines(df: DataFrame) -> DataFrame:
    """Lines of reads (qname, flag, chrom, start, mapq, cigar; mate_chrom, tlen,
    seq, quals and tags are optional). A whole number is an i tag, else Z."""
    have = set(df.columns)
    col = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other)) if c in have else F.lit(other)
    mate = F.when(F.col("mate_chrom") == F.col("chrom"), "=").otherwise(F.coalesce("mate_chrom", F.lit("*"))) if "mate_chrom" in have else F.lit("*")
    quals = F.when(F.size("quals") > 0, F.array_join(F.transform("quals", lambda q: F.char(q + 33)), "")).otherwise("*") if "quals" in have else F.lit("*")
    parts = [F.col("qname").cast("string"), F.col("flag").cast("string"), F.col("chrom"), (F.col("start") + 1).cast("string"), F.col("mapq").cast("string"), F.col("cigar"), mate, F.lit("0"), col("tlen", "0"), col("seq", "*"), quals]
    if "tags" in have:
        text = lambda k: F.concat(k, F.when(F.col("tags")[k].rlike(r"^-?\d+$"), ":i:").otherwise(":Z:"), F.col("tags")[k])
        parts.append(F.when(F.size("tags") > 0, F.array_join(F.transform(F.array_sort(F.map_keys("tags")), text), "\t")))
    return df.select("chrom", "start", F.concat_ws("\t", *parts).alias("value"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return sam_records(spark.read.text(path))


def write_sam(df: DataFrame, path: str) -> None:
    sam_lines(df).repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start", "value").select("value").write.mode("overwrite").text(path)


def write_reads(df: DataFrame, path: str) -> None:
    """Reads as Parquet, ranged and sorted by place."""
    df.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").write.mode("overwrite").parquet(path)


def fastq_lines(reads: DataFrame, mate: int) -> DataFrame:
    """Four lines per read of a mate (1 or 2). reads: qname, flag, seq, qual."""
    own = reads.where(F.col("flag").bitwiseAND(64 if mate == 1 else 128) != 0)
    lines = F.array(F.concat(F.lit("@"), F.col("qname").cast("string")), F.col("seq"), F.lit("+"), F.col("qual"))
    return own.select("qname", F.posexplode(lines).alias("line", "value"))


def fasta_records(blocks: DataFrame) -> DataFrame:
    """chrom, seq of FASTA records: value is a record without its '>' (a name
    line, then lines of sequence)."""
    rows = blocks.where(F.trim("value") != "")
    first = F.regexp_extract("value", r"^([^\n\r]*)", 1)
    return rows.select(F.split(first, r"\s+")[0].alias("chrom"), F.regexp_replace(F.substring("value", F.length(first) + 1, F.length("value")), r"\s", "").alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """A row per record. A contig is a row; windows of it are further rows (see
    fasta_region), so that no later step moves whole contigs."""
    return fasta_records(spark.read.option("lineSep", ">").text(path))


def fasta_blocks(genome: DataFrame, width: int = 60) -> DataFrame:
    """Records (chrom, value) with sequence lines of `width` bases."""
    lines = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("seq") / width).cast("int") - 1, F.lit(0))), lambda i: F.col("seq").substr(i * width + 1, F.lit(width)))
    return genome.select("chrom", F.concat(F.lit(">"), F.col("chrom"), F.lit("\n"), F.array_join(lines, "\n")).alias("value"))


def fasta_region(genome: DataFrame, regions: DataFrame, reverse: bool = False) -> DataFrame:
    """chrom, start, end, seq of regions (0-based). genome: chrom, seq."""
    seq = F.col("seq").substr(F.col("start") + 1, F.col("end") - F.col("start"))
    return regions.join(genome, "chrom").select("chrom", "start", "end", (reverse_complement(seq) if reverse else seq).alias("seq"))


def changed(old: DataFrame, new: DataFrame, key: str = "chrom") -> DataFrame:
    """Sequences of new whose MD5 differs from old's, or that old lacks."""
    before = old.select(key, F.md5("seq").alias("__m"))
    return new.withColumn("__n", F.md5("seq")).join(before, key, "left").where(~F.col("__m").eqNullSafe(F.col("__n"))).drop("__m", "__n")


def _escaped(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def _plain(c: Column) -> Column:
    for plain, entity in (('"', "&quot;"), (">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def _data(name: str, text: Column) -> list[Column]:
    return [F.lit(f'<data key="{name}">'), _escaped(text.cast("string")), F.lit("</data>")]


def graphml_nodes(nodes: DataFrame) -> DataFrame:
    """An element per node (id, chrom, start, end, strand), one a line."""
    parts = [x for c in ("chrom", "start", "end", "strand") for x in _data(c, F.col(c))]
    return nodes.select(F.concat(F.lit('<node id="'), _escaped(F.col("id")), F.lit('">'), *parts, F.lit("</node>")).alias("value"))


def graphml_lines(edges: DataFrame) -> DataFrame:
    """An element per edge (a, b, type, weight), one a line."""
    parts = [x for c in ("type", "weight") for x in _data(c, F.col(c))]
    return edges.select(F.concat(F.lit('<edge source="'), _escaped(F.col("a")), F.lit('" target="'), _escaped(F.col("b")), F.lit('">'), *parts, F.lit("</edge>")).alias("value"))


def graphml_document(nodes: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    """part, value: the lines of a whole document, by part."""
    kinds = {"chrom": ("node", "string"), "start": ("node", "int"), "end": ("node", "int"), "strand": ("node", "string"), "type": ("edge", "string"), "weight": ("edge", "double")}
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="{k}" for="{on}" attr.name="{k}" attr.type="{kind}"/>' for k, (on, kind) in kinds.items()]
    head.append(f'<graph edgedefault="{"directed" if directed else "undirected"}">')
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(3, 0, "</graph>"), (3, 1, "</graphml>")], "part int, line int, value string")
    body = graphml_nodes(nodes).select(F.lit(1).alias("part"), F.lit(0).alias("line"), "value").unionByName(graphml_lines(edges).select(F.lit(2).alias("part"), F.lit(0).alias("line"), "value"))
    return ends.unionByName(body)


def _get(pattern: str) -> Column:
    return _plain(F.regexp_extract("value", pattern, 1))


def read_graphml(lines: DataFrame) -> DataFrame:
    """a, b, type, weight of <edge> elements, one per line."""
    return lines.where(F.col("value").contains("<edge ")).select(_get('source="([^"]*)"').alias("a"), _get('target="([^"]*)"').alias("b"), _get('key="type">([^<]*)<').alias("type"), _get('key="weight">([^<]*)<').cast("double").alias("weight"))


def read_graphml_nodes(lines: DataFrame) -> DataFrame:
    """id, chrom, start, end, strand of <node> elements, one per line."""
    part = lambda k, kind="string": _get(f'key="{k}">([^<]*)<').cast(kind).alias(k)
    return lines.where(F.col("value").contains("<node ")).select(_get('id="([^"]*)"').alias("id"), part("chrom"), part("start", "int"), part("end", "int"), part("strand"))


def read_group_dirs(df: DataFrame, column: str = "name") -> DataFrame:
    return df.where(F.col(column).rlike(r"^RG\d+$"))
