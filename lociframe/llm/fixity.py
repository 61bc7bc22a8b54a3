"""WARC fixity: Merkle trees over records and their offset ranges.

A replica is a set of WARC files; a file is an ordered row of records, each at
an offset. Records are hashed; leaves are the records in order, and a node at
level k covers FAN ** k records, that is one offset range. Replicas are
compared from their roots down, and only children of nodes that differ are
joined, so whole trees never move for the sake of a few bad records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import clear_names, cut

FAN = 16
#: Records of a WARC file.
FILE_RECORDS = 512
#: Files of the records without an id.
NULL_FILES = 1 << 20


def record_bytes(url: Column, payload: Column) -> Column:
    """A WARC/1.1 response record: header, payload, two line ends. Nulls are
    empty."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def catalogue(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, file, seq (place in the file), offset, length, digest of every
    record. Files hold FILE_RECORDS consecutive ids each; a file's records are
    in order of id, then digest. Records without an id are in NULL_FILES files
    of negative numbers, by a hash."""
    clean = clear_names(pages, *[c for c in ("file", "seq", "offset", "length", "digest") if c not in (id_col, url_col, payload_col)])
    record = record_bytes(F.col(url_col).cast("string"), F.col(payload_col).cast("string"))
    rows = clean.select(F.col(id_col).cast("long").alias("page_id"), record.alias("r"))
    rows = rows.select("page_id", F.octet_length("r").cast("long").alias("length"), F.sha2("r", 256).alias("digest"))
    rows = rows.withColumn("file", F.coalesce(F.floor(F.col("page_id") / FILE_RECORDS), -1 - F.pmod(F.xxhash64("digest"), F.lit(NULL_FILES))).cast("long"))
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("page_id", "file", (F.row_number().over(order) - 1).cast("long").alias("seq"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"), "length", "digest")


def levels(records: int) -> int:
    """Levels above the leaves so that one root covers a file."""
    k, cover = 0, 1
    while cover < records:
        k, cover = k + 1, cover * FAN
    return k


def tree(records: DataFrame, height: int) -> DataFrame:
    """file, level, node, first_offset, end_offset, digest of every node.

    Level 0 are records; a node is the hash of its children's hashes in order,
    at most FAN of them, and of the lengths of their ranges. So a record that
    changes its length moves the records after it, but only its own ancestors
    differ.
    """
    leaf = F.sha2(F.concat_ws("|", "digest", "length"), 256)
    level = records.select("file", F.lit(0).alias("level"), F.col("seq").alias("node"), F.col("offset").alias("first_offset"), (F.col("offset") + F.col("length")).alias("end_offset"), leaf.alias("digest"))
    out = level
    for k in range(1, height + 1):
        children = F.sort_array(F.collect_list(F.struct("node", "digest", (F.col("end_offset") - F.col("first_offset")).alias("bytes"))))
        up = level.groupBy("file", F.floor(F.col("node") / FAN).alias("parent")).agg(F.min("first_offset").alias("first_offset"), F.max("end_offset").alias("end_offset"), children.alias("c"))
        digest = F.sha2(F.array_join(F.transform("c", lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["bytes"].cast("string"), F.lit(":"), x["digest"])), "|"), 256)
        level = up.select("file", F.lit(k).alias("level"), F.col("parent").alias("node"), "first_offset", "end_offset", digest.alias("digest"))
        out = out.unionByName(level)
    return out


def audit(left: DataFrame, right: DataFrame, height: int | None = None) -> DataFrame:
    """Places where two replicas' catalogues differ: file, seq, status.

    Roots are compared first; each further level joins only children of the
    nodes that differ. status: corrupt (both have the record, unlike), missing
    (the right has none), moved (the order differs) or extra (only the right has
    it; seq is its place there). Replicas that agree give no rows, and so do
    empty ones.
    """
    if height is None:
        most = left.select("seq").unionByName(right.select("seq")).agg(F.max("seq")).first()[0]
        if most is None:
            return left.select("file", "seq", F.lit("corrupt").alias("status"))  # of no rows
        height = levels(most + 1)
    a, b = cut(tree(left, height)), cut(tree(right, height))
    suspects: DataFrame | None = None
    for k in range(height, -1, -1):
        x = a.where(F.col("level") == k).select("file", "node", F.col("digest").alias("da"))
        y = b.where(F.col("level") == k).select("file", "node", F.col("digest").alias("db"))
        if suspects is not None:
            parent = F.floor(F.col("node") / FAN).alias("parent")
            x, y = (
                t.withColumn("parent", parent).join(suspects.select("file", F.col("node").alias("parent")), ["file", "parent"], "left_semi").drop("parent")
                for t in (x, y)
            )
        suspects = x.join(y, ["file", "node"], "full_outer").where(~F.col("da").eqNullSafe(F.col("db")))
        suspects = cut(suspects)
    return aligned(left, right, suspects)


def aligned(left: DataFrame, right: DataFrame, suspects: DataFrame) -> DataFrame:
    """What happened at the places that differ (suspects: file, node, da, db).

    A record that is lost or added inside a file moves all the ones after it,
    so records are matched by digest first (the k-th of a digest with the k-th);
    of the others those of one id are the same record, unlike; the rest is
    missing or extra. A file has a bounded number of records.
    """
    kinds = []
    for side, catalogue in (("da", left), ("db", right)):
        own = catalogue.join(suspects.where(F.col(side).isNotNull()).select("file", F.col("node").alias("seq")), ["file", "seq"], "left_semi")
        nth = F.row_number().over(Window.partitionBy("file", "digest", "length").orderBy("seq"))
        kinds.append(own.select("file", "seq", "page_id", "digest", "length", nth.alias("nth")))
    a, b = kinds
    same = ["file", "digest", "length", "nth"]
    both = cut(a.join(b.withColumnsRenamed({"seq": "seq_b", "page_id": "id_b"}), same, "full_outer"))
    order = lambda c: F.row_number().over(Window.partitionBy("file").orderBy(c))
    moved = both.where("seq is not null and seq_b is not null").withColumns({"x": order("seq"), "y": order("seq_b")}).where("x <> y")
    found = moved.select("file", "seq", F.lit(None).cast("long").alias("seq_b"), F.lit("moved").alias("status"))
    lone = lambda seq, own, other: both.where(F.col(seq).isNotNull() & F.col(other).isNull()).select("file", F.col(seq), F.coalesce(own, F.lit(0)).alias("id"), F.col(own).isNull().alias("no_id"), F.row_number().over(Window.partitionBy("file", own).orderBy(seq)).alias("k"))
    pairs = lone("seq", "page_id", "seq_b").join(lone("seq_b", "id_b", "seq"), ["file", "id", "no_id", "k"], "full_outer")
    status = F.when(F.col("seq_b").isNull(), "missing").when(F.col("seq").isNull(), "extra").otherwise("corrupt")
    found = found.unionByName(pairs.select("file", "seq", "seq_b", status.alias("status")))
    return found.select("file", F.when(F.col("status") == "extra", F.col("seq_b")).otherwise(F.col("seq")).alias("seq"), "status")


def checked(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """The catalogue of `pages` with the replica's status of each record (ok,
    corrupt, missing or moved) and records that only the replica has (extra).

    page_id, file, seq, offset, length, digest, status. Nulls are empty
    strings; repeated rows are records of their own; either table may be
    empty. Other columns are ignored.
    """
    own, other = cut(catalogue(pages)), cut(catalogue(replica))
    bad = cut(audit(own, other))
    known = own.join(bad.where("status <> 'extra'"), ["file", "seq"], "left")
    extra = other.join(bad.where("status = 'extra'"), ["file", "seq"])
    cols = ["page_id", "file", "seq", "offset", "length", "digest", "status"]
    return known.withColumn("status", F.coalesce("status", F.lit("ok"))).select(*cols).unionByName(extra.select(*cols))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage, for drills: of ids divisible by 97 one
    letter is changed, of those that leave 5 the end is lost (if there is one),
    and records inside and at the end of every file (ids that leave 40,
    FILE_RECORDS - 1 or - 2) are gone."""
    html = F.col("html")
    bad = F.when(F.pmod("page_id", F.lit(97)) == 0, F.concat(F.substring(html, F.lit(1), F.lit(100)), F.lit("~"), html.substr(F.lit(102), F.greatest(F.length(html), F.lit(1)))))
    bad = bad.when(F.pmod("page_id", F.lit(97)) == 5, html.substr(F.lit(1), F.greatest(F.length(html) - 7, F.lit(0)))).otherwise(html)
    place = F.pmod("page_id", F.lit(FILE_RECORDS))
    kept = F.coalesce((place < FILE_RECORDS - 2) & (place != 40), F.lit(True))
    return pages.where(kept).withColumn("html", bad)
