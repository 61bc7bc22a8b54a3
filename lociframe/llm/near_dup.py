"""Near-duplicate groups by HyperMinHash.

A document's set of five-word shingles is hashed into REGISTERS buckets; each
keeps its least hash in compressed form: the count of leading zeros and
MANTISSA bits after the first one. Bands of ROWS compressed registers find
candidates, the registers' collision-corrected Jaccard estimate drops most of
the false ones, and full shingle sets confirm the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, components, cut, fresh, mix64, shingle_hashes, words_of

SHINGLE = 5
#: Bands and registers of a band; estimates use all REGISTERS.
ROWS = 5
BANDS = 40
REGISTERS = 400
MANTISSA = 10
#: The code of a bucket without a hash.
EMPTY = 0xFFFF
#: Members of a bucket whose pairs are all tried in one round.
WHOLE = 4096
#: Members of a part of such a bucket; a task of its own takes each pair of parts.
PART = 512
#: Pairs of members that a task should try.
TASK_PAIRS = 1 << 18
#: Candidates that a task should confirm on full sets.
TASK_SETS = 512
#: Standard errors that an estimate may lie below the threshold.
SLACK = 4.5

_WORDS: list[WordHashes] = []


def _words() -> WordHashes:
    if not _WORDS:
        _WORDS.append(WordHashes())
    return _WORDS[0]


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles."""
    words = words_of(text)
    return shingle_hashes(_words()(words), n) if words else np.zeros(0, dtype=np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """REGISTERS codes: leading zeros above MANTISSA bits, or EMPTY."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    value = mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    np.minimum.at(least, (hashes % np.uint64(REGISTERS)).astype(np.int64), value)
    full = least != np.iinfo(np.uint64).max
    # the highest set bit; halves keep float conversion from rounding up
    high, low = (least >> np.uint64(32)).astype(np.float64), (least & np.uint64(0xFFFFFFFF)).astype(np.float64)
    zeros = np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1]).clip(0, 62).astype(np.uint64)
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return np.where(full, (zeros << np.uint64(MANTISSA)) | mantissa, EMPTY).astype("<u2")


#: For each bucket, the buckets that it borrows from, in order, if it is empty.
LENDERS = np.random.default_rng(11).integers(0, REGISTERS, size=(64, REGISTERS))


def filled(codes: np.ndarray) -> np.ndarray:
    """The registers with every empty one borrowed from the first of its lenders
    that has a code (or from the next bucket that has, if none of them does).

    So two sets agree in a borrowed register about as often as in one of their
    own, and small sets don't meet in bands of empty buckets.
    """
    out, left = codes.copy(), np.flatnonzero(codes == EMPTY)
    if len(left) == len(codes):
        return out
    for row in LENDERS:
        if not len(left):
            return out
        lent = codes[row[left]]
        out[left] = lent
        left = left[lent == EMPTY]
    have = np.flatnonzero(codes != EMPTY)
    out[left] = codes[have[np.searchsorted(have, left) % len(have)]]
    return out


def band_keys(codes: np.ndarray) -> np.ndarray:
    """A signed hash per band of filled registers (the first BANDS * ROWS)."""
    parts = filled(codes)[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
    return out.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of pairs of sketches (rows) of sets with n and m
    members, and the number of buckets that either fills.

    Equal registers count, less those expected to be equal by collision: two
    independent least values share a cell of width 2^-(z + 1 + MANTISSA) with
    the probability that the inner sum over the leading-zero counts z gives.
    """
    used = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & used).sum(axis=1)
    size = used.sum(axis=1)
    rate = (n + m)[:, None] / REGISTERS
    z = np.arange(0, 50)
    cell = 2.0 ** -(z + 1.0 + MANTISSA)
    prod = (n * m)[:, None] / REGISTERS**2
    inside = np.exp(-rate * 2.0 ** -(z + 1.0)) - np.exp(-rate * 2.0**-z)
    collide = (cell * prod / rate * inside).sum(axis=1) * REGISTERS
    j = same / np.maximum(size, 1)
    # only buckets that differ can collide by chance
    return np.clip((same - collide * (1 - j)) / np.maximum(size, 1), 0, 1), size


def likely(estimates: np.ndarray, used: np.ndarray, n: np.ndarray, m: np.ndarray, goal: float) -> np.ndarray:
    """Whether pairs with these estimates may reach the goal.

    The buckets in use hold the least hashes of a sample, drawn without
    replacement, of the union; so the deviation is that of a hypergeometric
    share, which vanishes for sets that are small beside REGISTERS.
    """
    union = np.maximum((n + m) / (1 + goal), used)
    left = np.maximum(union - used, 1) / np.maximum(union - 1, 1)
    return estimates >= goal - SLACK * np.sqrt(goal * (1 - goal) / np.maximum(used, 1) * np.minimum(left, 1)) - 1.0 / np.maximum(used, 1)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, print (of the text), n (set size), set1 and set2 (a 128-bit hash of
    the set), codes."""
    import xxhash

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = []
            for doc, text, print_ in zip(pdf["id"], pdf["text"], pdf["print"], strict=True):
                s = shingle_set(text)
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                out.append((doc, print_, len(s), h >> 65, h & (2**63 - 1), sketch(s).tobytes() if len(s) else b""))
            yield pd.DataFrame(out, columns=["id", "print", "n", "set1", "set2", "codes"])

    return printed(docs, id_col, text_col).mapInPandas(run, "id long, print long, n long, set1 long, set2 long, codes binary")


def printed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and print (a hash of the text, which tells rows of one id from
    each other) of the rows with an id."""
    narrow = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.withColumn("print", F.xxhash64("text"))


def _bands(reps: DataFrame) -> DataFrame:
    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            keys = [band_keys(np.frombuffer(c, dtype="<u2")) for c in pdf["codes"]]
            flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            ids = np.repeat(pdf["id"].to_numpy(), BANDS)
            yield pd.DataFrame({"key": flat, "id": ids})

    return reps.select("id", "codes").mapInPandas(run, "key long, id long")


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose estimate could belong to a link."""
    pairs = cut(pairs)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    side = cut(reps.select("id", "n", "codes").join(ids, "id", "left_semi"))
    left = side.select(*[F.col(c).alias(f"{c}_a") for c in side.columns])
    right = side.select(*[F.col(c).alias(f"{c}_b") for c in side.columns])
    both = pairs.join(right, F.col("b") == F.col("id_b")).join(left, F.col("a") == F.col("id_a"))
    # sets of such different sizes can't be that alike
    both = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).drop("id_a", "id_b")
    goal = percent / 100

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for at in range(0, len(pdf), 2000):
                p = pdf.iloc[at : at + 2000]
                a, b = (np.frombuffer(b"".join(p[c]), dtype="<u2").reshape(len(p), REGISTERS) for c in ("codes_a", "codes_b"))
                j, size = estimate(a, b, p["n_a"].to_numpy(float), p["n_b"].to_numpy(float))
                yield p.loc[likely(j, size, p["n_a"].to_numpy(float), p["n_b"].to_numpy(float), goal), ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def _within(members: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (id_a, id_b) of members of a bucket (of k, at most WHOLE) in different
    components whose sizes and estimate allow a link; a pair that shares several
    buckets is given in the first of its bands only.

    A bucket is split into parts by a hash of its members, and each pair of
    parts is a group; so neither a large bucket nor few partitions make a task
    long. The number of tasks grows with the pairs to try.
    """
    goal = percent / 100
    of = F.ceil(F.col("k") / PART)
    work = members.groupBy("key").agg(F.first("k").alias("k")).agg(F.sum(F.col("k") * F.col("k") / 2)).first()[0] or 0
    split = members.join(reps.select("id", "codes"), "id").withColumn("part", F.pmod(F.xxhash64("id"), of)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), of - 1)))
    split = split.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).select("key", "low", "high", "part", "id", "n", "c", "codes")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
        # the rows of the first part come first; each meets those after it, or those of the other part
        pdf = pdf.sort_values(["part", "id"], kind="stable")
        ids, n, c = (pdf[x].to_numpy() for x in ("id", "n", "c"))
        codes = np.frombuffer(b"".join(pdf["codes"]), dtype="<u2").reshape(len(pdf), REGISTERS)
        keys = np.stack([band_keys(x) for x in codes])
        band = int(np.argmax(keys[0] == pdf["key"].iloc[0]))
        first = int((pdf["part"] == low).sum())
        out = []
        for i in range(first):
            j = np.arange(i + 1 if low == high else first, len(pdf))
            j = j[(c[j] != c[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
            j = j[~(keys[j, :band] == keys[i, :band]).any(axis=1)]
            if len(j):
                own = np.full(len(j), float(n[i]))
                like, size = estimate(codes[j], codes[i][None], n[j].astype(float), own)
                j = j[likely(like, size, n[j].astype(float), own, goal)]
                out.append(np.stack([np.full(len(j), ids[i]), ids[j]], axis=1))
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64), columns=["id_a", "id_b"])

    dealt = split.repartition(int(work // TASK_PAIRS) + 1, "key", "low", "high")
    return dealt.groupBy("key", "low", "high").applyInPandas(run, "id_a long, id_b long")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, n: int = SHINGLE) -> DataFrame:
    """The pairs that full sets confirm: 100 intersection >= percent union.

    A row a with very many pairs stands once for every TASK_SETS of them, and the
    number of tasks grows with the pairs: few bytes can be much work here.
    """
    share = pairs.groupBy("a").agg(F.ceil(F.count("*") / TASK_SETS).alias("of"))
    dealt = pairs.join(share, "a").select("a", "b", F.pmod(F.xxhash64("b"), "of").alias("part"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).join(share, "a")
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1))).drop("of")
    both = dealt.join(right, "b").repartition(pairs.count() // TASK_SETS + 1, "a", "part").join(left, ["a", "part"]).sortWithinPartitions("a", "part")

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, mine = None, None
        for pdf in rows:
            keep = []
            for a, ta, tb in zip(pdf["a"], pdf["text_a"], pdf["text_b"], strict=True):
                if a != last:
                    last, mine = a, shingle_set(ta, n)
                other = shingle_set(tb, n)
                shared = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * shared >= percent * (len(mine) + len(other) - shared))
            yield pdf.loc[keep, ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def _classes(rows: DataFrame) -> DataFrame:
    """key, n, set1, set2, codes, rep and print (the first row) of each distinct
    set that isn't empty. Keys are numbers, since ids may be shared, in the
    order of the first rows: a bucket's least key is then the earliest text,
    which the others are copies of more often than of one another."""
    found = rows.where("n > 0").groupBy("n", "set1", "set2").agg(F.min(F.struct("id", "print")).alias("r"), F.first("codes").alias("codes"))
    flat = found.select("n", "set1", "set2", "codes", F.col("r.id").alias("rep"), F.col("r.print").alias("print"))
    ordered = flat.repartitionByRange("rep", "print", "set1", "set2").sortWithinPartitions("rep", "print", "set1", "set2")
    return cut(ordered.withColumn("key", F.monotonically_increasing_id()))


def _same_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that share an id."""
    spread = rows.where("n > 0").groupBy("id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("set1", "set2") for f in (F.min, F.max)])
    shared = spread.where("min_set1 <> max_set1 or min_set2 <> max_set2").select("id")
    own = rows.join(shared, "id", "left_semi").select("id", "n", "set1", "set2").distinct().join(classes.select("key", "n", "set1", "set2"), ["n", "set1", "set2"])
    least = own.groupBy("id").agg(F.min("key").alias("a"))
    return own.join(least, "id").where("a < key").select("a", F.col("key").alias("b"))


def _linked(rows: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, by_id: bool) -> DataFrame:
    """classes (without codes) and component_key of each class.

    Candidates: each bucket first pairs its smallest member with the others.
    Where a bucket of up to WHOLE members still holds several components, all
    pairs between them (of sizes that can be that alike) are tried; of a larger
    one about 2 sqrt(k) members at a time meet all the others and are done,
    again and again until at most WHOLE are left or all are one component. So
    no pair between components of a bucket stays untried, no bucket or
    candidate is capped, and every step is an aggregation, a join or a narrow
    map.
    """
    reps = classes.select(F.col("key").alias("id"), "n", "codes")
    bands = _bands(reps)
    buckets = bands.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("size")).where("size > 1")
    members = cut(bands.join(buckets, "key").select("key", "id", "lead"))

    def confirm(pairs: DataFrame) -> DataFrame:
        """Tries candidate pairs (a, b)."""
        likely = cut(_estimated(pairs, reps, percent))
        ids = likely.select(F.col("a").alias("key")).union(likely.select("b")).distinct()
        # the text of each class's first row
        first = classes.join(ids, "key", "left_semi").select("key", F.col("rep").alias("id"), "print")
        own = texts.join(first, ["id", "print"]).select(F.col("key").alias("id"), "text").dropDuplicates(["id"])
        return cut(_verified(likely, own, percent))

    links = confirm(members.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    if by_id:
        links = cut(links.unionByName(_same_id(rows, classes)))
    comp = cut(components(links))
    # the members that have not yet been paired with all others of their bucket
    rest, turn = members.where("id <> lead").join(reps.select("id", "n"), "id").select("key", "id", "n"), 0
    alike = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    while True:
        known = rest.join(comp, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
        open_ = known.groupBy("key").agg(F.count("*").alias("k"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
        rest = cut(known.join(open_.select("key", "k"), "key"))
        if rest.isEmpty():
            break
        small = _within(rest.where(F.col("k") <= WHOLE), reps, percent)
        # of larger buckets a few members, chosen by hash, meet all the others
        x, y = (rest.where(F.col("k") > WHOLE).select("key", "k", *[F.col(c).alias(f"{c}_{z}") for c in ("id", "n", "c")]) for z in "ab")
        large = x.where(F.pmod(F.xxhash64("id_a", F.lit(turn)), "k") < F.ceil(2 * F.sqrt("k"))).join(y.drop("k"), "key").where("c_a <> c_b").where(alike)
        pairs = small.unionByName(large.select("id_a", "id_b"))
        links = cut(links.unionByName(confirm(pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct())))
        comp = cut(components(links))
        done = F.pmod(F.xxhash64("id", F.lit(turn)), "k") < F.ceil(2 * F.sqrt("k"))
        rest, turn = rest.where((F.col("k") > WHOLE) & ~done).select("key", "id", "n"), turn + 1
    out = classes.drop("codes").join(comp.withColumnRenamed("id", "key"), "key", "left")
    return out.withColumn("component_key", F.coalesce("component", "key")).drop("component")


def groups(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row with an id.

    Links: 100 * intersection >= percent * union of shingle sets. A text of
    fewer than five words is one shingle; one without words links with none.
    Equal sets are one class and stand as their first row; no pair is made
    within a class. Rows that share an id are linked, whatever their texts are
    like: every one of them keeps its own links. Rows without an id are left
    out here; near_duplicates() returns them.
    """
    rows = cut(sketches(docs, id_col, text_col))
    classes = _classes(rows)
    linked = _linked(rows, classes, printed(docs, id_col, text_col), percent, True)
    least = linked.groupBy("component_key").agg(F.min("rep").alias("component_id"))
    told = cut(linked.join(least, "component_key").select("n", "set1", "set2", "component_id"))
    # a class of very many rows is split by the join, which no aggregate shares
    out = rows.select("id", "n", "set1", "set2").join(told, ["n", "set1", "set2"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates: the one of least id
    (then of least text hash). Unlike texts stay, also if they share an id; a
    row that is there several times stays once; of texts without words every
    distinct row stays, and rows without an id all do."""
    rows = cut(sketches(docs, id_col, text_col))
    linked = _linked(rows, _classes(rows), printed(docs, id_col, text_col), percent, False)
    first = linked.groupBy("component_key").agg(F.min(F.struct("rep", "print")).alias("r")).select(F.col("r.rep").alias("id"), F.col("r.print").alias("print"))
    kept = first.unionByName(rows.where("n = 0").select("id", "print").distinct())
    key, print_ = fresh(docs, "id"), fresh(docs, "print")
    told = docs.withColumns({key: F.col(id_col).cast("long"), print_: F.xxhash64(F.col(text_col).cast("string"))})
    out = told.where(F.col(key).isNotNull()).join(kept.withColumnsRenamed({"id": key, "print": print_}), [key, print_], "left_semi").dropDuplicates([key, print_])
    return out.unionByName(told.where(F.col(key).isNull())).select(*docs.columns)


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_shingles, component_id, kept (the row that stands for
    its component). A row without an id has no component and is kept; rows
    that share an id are all rows of that id, kept alike. An empty table gives
    no rows; other columns are ignored."""
    found = groups(docs, percent, id_col, text_col)
    out = found.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    lone = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias(id_col), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(lone)
