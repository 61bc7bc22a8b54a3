"""Document fingerprints by consistent weighted sampling, in SQL functions.

A term is a lower-cased word pair (a one-word text has that word), its weight
the number of its occurrences. For each of SAMPLES samples and each term, with
r and c from gamma(2, 1) and beta uniform, all hashed from (term, sample):
t = floor(ln(weight) / r + beta), y = exp(r (t - beta)), a = c / (y exp(r)).
The sample is (term, t) of the least a. Two texts agree in a sample with the
probability of their generalised Jaccard similarity.

The draws are made in an order that spares most of them. Write
e = r (1 - beta) and d = r beta: two independent exponentials, with r = e + d.
At weight 1, t is 0 and a = c exp(-e), which is exponential too, so one hash
gives its quantile and hashes compare as the values do. A weight over 1 asks
for the rest: t = floor((ln(weight) + d) / r) and a = c exp(-e - r t), with
c = a(1) + an exponential and e = ln(c / a(1)), which is how c and e lie given
their a(1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_parts

SAMPLES = 32
#: Samples that one row of a repeated term carries.
LANES = 2
SEED = 77
#: The only term of a text without words.
EMPTY = -7046029254386353131
SPACE = r"[\x20\x09-\x0D]"


def light_key(term: Column, k: Column) -> Column:
    """A long that orders by a(1) and names the term."""
    return F.xxhash64(term, F.lit(SEED * 1000) + k)


def heavy_keys(rows: DataFrame, kept: list[str], lanes: int = LANES) -> DataFrame:
    """kept and h0, h1, ...: of a row's term, w (logarithm of its weight) and g,
    longs that order by a among light keys and name (term, t), if t > 0 (else
    the light key stands): the upper 32 bits order, the lower 32 are a hash of
    (term, t). Null where w is null. Each step is a projection of its own: so
    nothing is worked out twice, and the code stays small enough to compile."""
    each = lambda make: [c.alias(f"{n}{j}") for j in range(lanes) for n, c in make(j).items()]
    v = lambda n, j: F.col(f"{n}{j}")
    share = lambda bits: (bits.bitwiseAND(0xFFFFFFFF).cast("double") + 0.5) * 2.0**-32
    out = rows.select(*kept, "w", *each(lambda j: {"h": F.when(F.col("w").isNotNull(), light_key(F.col("term"), F.col("g") * lanes + j))}))
    out = out.select(*kept, "w", *each(lambda j: {"h": v("h", j), "a": -F.log1p((v("h", j).cast("double") + (2.0**63 + 0.5)) * -(2.0**-64)), "m": F.when(v("h", j).isNotNull(), F.xxhash64(v("h", j)))}))
    out = out.select(*kept, "w", *each(lambda j: {"h": v("h", j), "a": v("a", j), "e": F.ln(v("a", j) - F.ln(share(v("m", j)))) - F.ln(v("a", j)), "d": -F.ln(share(F.shiftrightunsigned(v("m", j), 32)))}))
    out = out.select(*kept, *each(lambda j: {"h": v("h", j), "a": v("a", j), "r": v("e", j) + v("d", j), "t": F.floor((F.col("w") + v("d", j)) / (v("e", j) + v("d", j)))}))
    quantile = lambda j: -F.expm1(-v("a", j) * F.exp(v("r", j) * -v("t", j))) * 2.0**32
    return out.select(*kept, *each(lambda j: {"h": F.when(v("t", j) > 0, F.shiftleft(quantile(j).cast("long") - (1 << 31), 32).bitwiseOR(F.xxhash64(v("h", j), v("t", j)).bitwiseAND(0xFFFFFFFF)))}))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), f"{SPACE}+"), "")


def _pairs(words: str) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda x, y: F.xxhash64(x, y))


def hashed_pairs(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, p, x and y from text, edited and same (how many code points both
    begin with): the terms that both have from there, and the rest of the
    text's and of the edited text's. Words are split once for both. Each step
    is a projection of its own, so that no array is made twice."""
    # whole words only: the shared part ends with its last white space
    out = df.select(*keys, "text", "edited", F.regexp_extract(F.substring("text", F.lit(1), F.col("same")), f"(?s)^.*{SPACE}", 0).alias("head"))
    rest = F.char_length("head") + 1
    out = out.select(*keys, _words(F.col("head")).alias("w"), *[_words(F.substring(c, rest, F.lit((1 << 31) - 1))).alias(z) for c, z in (("text", "x"), ("edited", "y"))])
    last = F.slice("w", -1, F.least(F.size("w"), F.lit(1)))
    out = out.select(*keys, "w", *[F.concat(last, z).alias(z) for z in "xy"], *[(F.size("w") + F.size(z)).alias(f"n_{z}") for z in "xy"])
    terms = lambda z: F.when(F.col(f"n_{z}") == 0, F.array(F.lit(EMPTY))).when(F.col(f"n_{z}") == 1, F.transform(z, lambda v: F.xxhash64(v))).otherwise(_pairs(z))
    return out.select(*keys, _pairs("w").alias("p"), terms("x").alias("x"), terms("y").alias("y"))


def _repeated(out: DataFrame, kept: list[str], terms: Column, z: str) -> DataFrame:
    """Adds r_{z} and w_{z}: the terms that occur more than once, and the
    logarithms of how often."""
    before = lambda i: F.get(F.col("s"), F.greatest(i - 1, F.lit(0)))
    out = out.select(*kept, F.sort_array(terms).alias("s"))
    out = out.select(*kept, F.filter("s", lambda v, i: (i > 0) & (v == before(i))).alias("s"))
    size = F.size("s")
    starts = F.when(size > 0, F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: (i == 0) | (F.get(F.col("s"), i) != before(i)))).otherwise(F.expr("cast(array() as array<int>)"))
    out = out.select(*kept, "s", starts.alias("b"))
    ends = F.when(F.size("b") > 0, F.concat(F.slice("b", 2, F.size("b")), F.array(F.size("s")))).otherwise(F.col("b"))
    # a term that occurs n times is n - 1 times among the repeated ones
    return out.select(*kept, F.transform("b", lambda i: F.get(F.col("s"), i)).alias(f"r_{z}"), F.zip_with("b", ends, lambda i, j: F.ln((j - i + 1).cast("double"))).alias(f"w_{z}"))


def fingerprint_rows(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys, f and g: the fingerprints (array<long>) of the text and of the
    edited text, from hashed_pairs(). Grouping by keys needs no exchange if
    terms is already dealt out by some of them.

    A term's sample can only fall as its weight grows. So each occurrence is
    taken at weight 1, and a repeated term once more at its weight; what both
    texts share is sampled once.
    """
    out = _repeated(terms, [*keys, "p", "x", "y"], F.concat("p", "x"), "x")
    out = _repeated(out, [*keys, "p", "x", "y", "r_x", "w_x"], F.concat("p", "y"), "y")
    groups, none = -(-samples // LANES), lambda kind: F.expr(f"cast(array() as array<{kind}>)")

    def weighed(z: str) -> Column:
        """Occurrences, then the repeated terms for each group of samples."""
        more = F.size(f"r_{z}")
        terms = F.concat(z, F.flatten(F.array_repeat(f"r_{z}", groups)))
        weights = F.concat(F.array_repeat(F.lit(None).cast("double"), F.size(z)), F.flatten(F.array_repeat(f"w_{z}", groups)))
        group = F.concat(F.array_repeat(F.lit(None).cast("int"), F.size(z)), *[F.array_repeat(F.lit(i), more) for i in range(groups)])
        return F.arrays_zip(terms.alias("term"), weights.alias("w"), group.alias("g"))

    parts = [F.struct(F.lit(e).alias("e"), zipped.alias("z")) for e, zipped in enumerate((F.arrays_zip(F.col("p").alias("term"), none("double").alias("w"), none("int").alias("g")), weighed("x"), weighed("y")))]
    rows = out.select(*keys, F.explode(F.array(*parts)).alias("q")).select(*keys, F.col("q.e").alias("e"), F.col("q.z").alias("z"))
    rows = rows.select(*keys, "e", F.explode("z").alias("z")).select(*keys, "e", F.col("z.term").alias("term"), F.col("z.w").alias("w"), F.col("z.g").alias("g"))
    rows = heavy_keys(rows, [*keys, "e", "term", "g"])
    key = lambda k: F.when(F.col("g").isNull(), light_key(F.col("term"), F.lit(k))).when(F.col("g") == k // LANES, F.col(f"h{k % LANES}"))
    least = rows.groupBy(*keys, "e").agg(*[F.min(key(k)).alias(f"k{k}") for k in range(samples)])
    of = lambda other, k: F.min(F.when(F.col("e") != other, F.col(f"k{k}"))).bitwiseAND(0xFFFFFFFF)
    both = least.groupBy(*keys).agg(*[of(other, k).alias(f"{z}{k}") for z, other in (("f", 2), ("g", 1)) for k in range(samples)])
    return both.select(*keys, *[F.array(*[f"{z}{k}" for k in range(samples)]).alias(z) for z in "fg"])


def as_hex(fingerprint: Column) -> Column:
    """Eight hex digits a sample."""
    return F.array_join(F.transform(fingerprint, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples; texts without words are alike (1)."""
    return F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda v: v["x"] == v["y"])) / float(samples)


def bounds(docs: DataFrame, id_col: str, buckets: int) -> list[int]:
    """At most buckets - 1 ids that part the rows into ranges of like size."""
    q = [i / buckets for i in range(1, buckets)]
    got = docs.agg(F.percentile_approx(id_col, q, 20 * buckets).alias("q")).first()["q"] if q else []
    return sorted(set(got or []))


def range_of(value: Column, cuts: list[int], width: int = 64) -> Column:
    """How many of the ascending cuts are below value, by two short scans."""
    chunks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    if not chunks:
        return F.lit(0)
    longs = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<long>")
    below = lambda array: F.size(F.filter(array, lambda c: c < value))
    whole = below(longs([c[-1] for c in chunks]))
    # past the last chunk all are below; its own place among the chunks says so
    own = F.split(F.get(F.split(F.lit(";".join(",".join(map(str, c)) for c in chunks)), ";"), whole), ",").cast("array<long>")
    return whole * width + F.when(whole < len(chunks), below(own)).otherwise(F.lit(len(cuts) - len(chunks) * width))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket, place, guest, id, text, next_text: the next row's text in
    descending id order, the first row's after the last. Rows with equal ids
    follow by text; null ids come last.

    One exchange deals texts to id ranges, four for each shuffle partition. A
    copy of the first row of the next range that has rows is the last row of
    each range, as a guest: so no range needs another.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # ids alone decide the ranges; a range holds about rows / buckets rows
    cuts = bounds(narrow, "id", 4 * shuffle_parts(docs.sparkSession))
    rows = narrow.withColumn("bucket", F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(len(cuts) - range_of(F.col("id"), cuts)))
    tops = cut(rows.groupBy("bucket").agg(F.max("id").alias("top")))
    # a row for each range
    back = tops.select(F.col("bucket").alias("own"), "top", F.lag("bucket").over(Window.orderBy("bucket")).alias("to"))
    back = back.crossJoin(F.broadcast(tops.agg(F.max("bucket").alias("last")))).select("own", "top", F.coalesce("to", "last").alias("to"))
    first = rows.join(F.broadcast(back), (F.col("bucket") == F.col("own")) & F.col("id").eqNullSafe(F.col("top"))).groupBy("to").agg(F.min("text").alias("text"))
    guests = first.select(F.lit(None).cast("long").alias("id"), "text", F.col("to").alias("bucket"), F.lit(True).alias("guest"))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc_nulls_last(), "text")
    every = rows.withColumn("guest", F.lit(False)).unionByName(guests)
    return every.withColumns({"next_text": F.coalesce(F.lead("text").over(order), F.lit("")), "place": F.row_number().over(order)})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next of every row.

    The edited text has the last floor(n_chars / 3) code points replaced by the
    first as many (or all) of the next row's text. A null text is empty; an
    empty table gives no rows; repeated rows and ids are ordinary rows (see
    neighbours() for their order); a table of one row is its own next. Other
    columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = neighbours(docs, "id", "text")
    n, k = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k))
    base = rows.select("bucket", "place", "guest", "id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), (n - k).alias("same"))
    prints = fingerprint_rows(hashed_pairs(base, ["bucket", "place"]), ["bucket", "place"], samples)
    known = base.select("bucket", "place", "guest", "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    out = prints.join(known, ["bucket", "place"]).withColumn("nxt", F.lead("f").over(Window.partitionBy("bucket").orderBy("place")))
    return out.where(~F.col("guest")).select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", as_hex(F.col("f")).alias("fingerprint"), as_hex(F.col("g")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("g"), samples).alias("near_edited"), likeness(F.col("f"), F.col("nxt"), samples).alias("near_next"),
    )
