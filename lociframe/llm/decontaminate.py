"""Benchmark decontamination with SimHash over item-sized windows.

Every window of a document whose size fits a benchmark item gets a 64-bit
SimHash of its words. Fingerprints are cut into BLOCKS blocks of 16 bits; two
within RADIUS differ by at most FLIPS bits in some block, so looking up each
block's value among the items' block values and their FLIPS-bit neighbours
misses none within RADIUS. Candidates are verified by the similarity of exact
shingles, plain or weighted.

Window sizes: an item of L words is looked for by the largest size on a ladder
(ratio LADDER) of at most L - 2 words (the item's own size below MIN_LADDER),
once from its head and once from its tail; so few sizes serve all items, and a
change in the last or first words leaves one anchor as it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, fresh, mix64, words_of

SHINGLE = 5
BLOCKS, BLOCK_BITS = 4, 16
RADIUS = 7
FLIPS = RADIUS // BLOCKS
LADDER = 1.4
MIN_LADDER = 10
#: Items whose fingerprints are broadcast at once; more are done in blocks.
ITEM_BLOCK = 20_000
#: Entries of the table that says which shingles some item may have.
TABLE = 1 << 20
#: Words handled at once in a worker.
CHUNK = 4096
PUNCTUATION = bytes(i for i in range(33, 127) if not chr(i).isalnum())


def normal(word: bytes) -> bytes:
    """A word without ASCII punctuation at its ends (kept if nothing is left)."""
    return word.strip(PUNCTUATION) or word


def sizes(limit: int) -> list[int]:
    """The ladder of window sizes up to limit."""
    out = list(range(1, MIN_LADDER + 1))
    while out[-1] < limit:
        out.append(max(out[-1] + 1, int(out[-1] * LADDER)))
    return [s for s in out if s <= limit]


def simhashes(words: np.ndarray, size: int, ones: np.ndarray) -> np.ndarray:
    """SimHash of every window of `size` words; ones: running counts of set
    bits, one row more than words."""
    got = (ones[size:] - ones[:-size]) > size // 2
    return np.packbits(got, axis=1).view("<u8").reshape(-1)


def running_ones(words: np.ndarray, longest: int) -> np.ndarray:
    """Per-bit running counts over a row of word hashes. They may wrap around;
    differences over at most `longest` words don't."""
    out = np.zeros((len(words) + 1, 64), dtype=np.int16 if longest < 1 << 15 else np.int32)
    out[1:] = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1)
    return np.cumsum(out, axis=0, out=out)


def shingle_counts(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of five-word shingles (fewer words: one) and their counts."""
    k = len(words)
    m = min(SHINGLE, k)
    h = np.zeros(max(0, k - m + 1) if k else 0, dtype=np.uint64)
    for i in range(m):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mix64(words[i : i + len(h)])
    return np.unique(h, return_counts=True)


class Items:
    """A block of the benchmark: fingerprints, block tables, shingles, weights.

    A shingle's weight is 1 / (the number of unlike texts of the whole benchmark
    that hold it): what many items share says less, and an item that is listed
    twice weighs as one. It is 1 for shingles of no item. held: those numbers
    where they are over 1, by shingle.
    """

    def __init__(self, ids: list, texts: list[str | None], held: dict[int, int]):
        hashes = WordHashes(normal)
        self.ids = ids
        self.words = [hashes(words_of(t)) for t in texts]
        self.shingles = [shingle_counts(w) for w in self.words]
        every = np.concatenate([s for s, _ in self.shingles]) if ids else np.zeros(0, dtype=np.uint64)
        self.known = np.unique(every)
        self.weight = np.array([1.0 / held.get(x, 1) for x in self.known.tolist()])
        self.lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        self.table = np.zeros(TABLE, dtype=bool)
        self.table[(self.known & np.uint64(TABLE - 1)).astype(np.int64)] = True
        ladder = np.array(sizes(max([1, *map(len, self.words)])))
        by_size: dict[int, list] = {}
        for k, w in enumerate(self.words):
            if not len(w):
                continue
            n = len(w)
            size = n if n < MIN_LADDER else int(ladder[ladder <= n - 2][-1])
            ones = running_ones(w, n)
            prints = simhashes(w, size, ones)
            by_size.setdefault(size, []).append((k, 0, prints[0]))
            if n > size:
                by_size[size].append((k, n - size, prints[-1]))
        self.classes = {size: self._class(rows) for size, rows in sorted(by_size.items())}

    @staticmethod
    def _class(rows: list):
        prints = np.array([p for _, _, p in rows], dtype=np.uint64)
        tables, flips = [], np.array([0, *(1 << b for b in range(BLOCK_BITS))])
        for block in range(BLOCKS):
            own = ((prints >> np.uint64(BLOCK_BITS * block)) & np.uint64(0xFFFF)).astype(np.int64)
            # values within a flip, and the prints of each value in one row
            values = (own[:, None] ^ flips).reshape(-1)
            order = np.argsort(values, kind="stable")
            first = np.searchsorted(values[order], np.arange((1 << BLOCK_BITS) + 1))
            tables.append((np.diff(first) > 0, first, np.repeat(np.arange(len(prints)), len(flips))[order]))
        return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), prints, tables

    @staticmethod
    def _near(got: np.ndarray, fits: np.ndarray | None, prints: np.ndarray, tables: list) -> tuple[np.ndarray, np.ndarray]:
        """(window, print) pairs within RADIUS; fits: which windows count."""
        low = got.view("<u2").reshape(-1, BLOCKS).T.astype(np.int64)
        windows, others = [], []
        for values, (has, first, members) in zip(low, tables, strict=True):
            hit = has.take(values)
            if fits is not None:
                hit &= fits
            hits = np.flatnonzero(hit)
            begin = first[values[hits]]
            count = first[values[hits] + 1] - begin
            w = np.repeat(hits, count)
            k = members[np.arange(len(w)) + np.repeat(begin - np.cumsum(count) + count, count)]
            near = np.bitwise_count(got[w] ^ prints[k]) <= RADIUS
            windows.append(w[near])
            others.append(k[near])
        return np.concatenate(windows), np.concatenate(others)

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.ones(len(shingles))
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return np.where(self.known[at] == shingles, self.weight[at], 1.0)

    def similarity(self, item: int, words: np.ndarray) -> float:
        """The greater of the plain and the weighted Jaccard similarity: sum of
        weight * least count over that of the greatest count, over the shingles
        of the item and the window."""
        (s, c), (t, d) = self.shingles[item], shingle_counts(words)
        both, i, j = np.intersect1d(s, t, assume_unique=True, return_indices=True)
        shared = np.minimum(c[i], d[j])
        ws, wt = self.weights(s), self.weights(t)
        low = float((self.weights(both) * shared).sum())
        high, plain = float((ws * c).sum() + (wt * d).sum()) - low, int(c.sum() + d.sum() - shared.sum())
        return max(low / high, int(shared.sum()) / plain) if plain else 0.0

    def candidates(self, words: np.ndarray, starts: np.ndarray, similarity: float):
        """(document, item, window start, window end) of windows within RADIUS
        of which enough shingles may be known.

        words: hashes of several documents in a row; starts: where each one
        begins, and the end. A document shorter than a size is one window.
        """
        ones, n = running_ones(words, max(self.classes, default=0)), len(words)
        lengths = np.diff(starts)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        left = starts[1:][owner] - np.arange(n)  # words up to the document's end
        found = []
        for size, (items, heads, prints, tables) in self.classes.items():
            pairs = []
            if n >= size:
                # a window must not cross into the next document
                pairs.append(self._near(simhashes(words, size, ones), left[: n - size + 1] >= size, prints, tables))
            # even a whole match of a shorter document would be too unlike
            short = np.flatnonzero((lengths < size) & (lengths >= similarity * size))
            if len(short):
                a, k = starts[short], lengths[short]
                got = np.packbits((ones[a + k] - ones[a]) > (k // 2)[:, None], axis=1).view("<u8").reshape(-1)
                x, k = self._near(got, None, prints, tables)
                pairs.append((a[x], k))
            for x, k in pairs:
                d = owner[x]
                begin = np.maximum(starts[d], x - heads[k])
                found.append(np.stack([d, items[k], begin, np.minimum(begin + self.lengths[items[k]], starts[d + 1])], axis=1))
        if not found:
            return np.zeros((0, 4), dtype=np.int64)
        rows = np.unique(np.concatenate(found), axis=0)
        # a window is no more alike than the share of its shingles that any item
        # has; the table may say yes to others too
        count = np.concatenate([[0], np.cumsum(self.table[(_rolled(words) & np.uint64(TABLE - 1)).astype(np.int64)])]) if n >= SHINGLE else np.zeros(1)
        inside = np.maximum(rows[:, 3] - rows[:, 2] - SHINGLE + 1, 0)
        last = np.minimum(rows[:, 2] + inside, len(count) - 1)
        known = count[last] - count[np.minimum(rows[:, 2], len(count) - 1)]
        return rows[(inside == 0) | (known >= similarity * inside - 1e-9)]


def _rolled(words: np.ndarray) -> np.ndarray:
    """The hash of the shingle that begins at each word."""
    h = np.zeros(max(0, len(words) - SHINGLE + 1), dtype=np.uint64)
    mixed = mix64(words)
    for i in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mixed[i : i + len(h)]
    return h


def _batches(texts: list, hashes: WordHashes):
    """Word hashes of about CHUNK words of whole documents at a time."""
    some, docs, n = [], [], 0
    for k, t in enumerate(texts):
        w = words_of(t)
        if w:
            some.append(hashes(w))
            docs.append(k)
            n += len(w)
        if n >= CHUNK:
            yield some, docs
            some, docs, n = [], [], 0
    if docs:
        yield some, docs


_WORDS: list[WordHashes] = []


def _worker_words() -> WordHashes:
    if not _WORDS:
        _WORDS.append(WordHashes(normal))
    return _WORDS[0]


def _shingles(items: DataFrame) -> DataFrame:
    """print (a hash of an item's words) and shingle, for each distinct one."""
    import xxhash

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for text in pdf["text"]:
                words = _worker_words()(words_of(text))
                own = shingle_counts(words)[0].view(np.int64)
                rows.append(pd.DataFrame({"print": np.full(len(own), xxhash.xxh3_64_intdigest(words.tobytes()) >> 1, dtype=np.int64), "shingle": own}))
            yield pd.concat(rows) if rows else pd.DataFrame({"print": np.zeros(0, dtype=np.int64), "shingle": np.zeros(0, dtype=np.int64)})

    return items.select("text").mapInPandas(run, "print long, shingle long").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item it holds: id, item_id, start (word),
    n_words and similarity of the best window (first of the best ones).

    Words are lower-cased and lose punctuation at their ends. Null or empty
    texts on either side match nothing; repeated documents match each; an empty
    benchmark or table gives no rows; a null id stays null. Items are a stated
    query set: they are broadcast ITEM_BLOCK at a time, by ascending id and text
    (an id may be in several blocks), and each block scans all documents. Rows
    with equal id and text are one item. Weights hang on the whole benchmark and
    not on blocks or repeated items. Other columns are ignored.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    asked = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).where("text <> ''")
    asked = cut(asked.distinct())
    # shingles that several unlike items hold
    shared_by = cut(_shingles(asked).groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1"))
    schema = "doc_id long, item_id long, start int, n_words int, similarity double"
    out, block = None, asked
    while True:
        # a bounded block of the query set; null ids come first
        rows = block.orderBy(F.col("id").asc_nulls_first(), "text").limit(ITEM_BLOCK).collect()
        if not rows:
            break
        if len(rows) < ITEM_BLOCK and out is None:
            held = shared_by  # all items are in this block
        else:
            held = shared_by.join(_shingles(spark.createDataFrame([(r.text,) for r in rows], "text string")), "shingle", "left_semi")
        counts = {r.shingle % (1 << 64): r.held for r in held.collect()}  # at most the block's shingles
        shared = spark.sparkContext.broadcast(Items([r.id for r in rows], [r.text for r in rows], counts))
        found = narrow.mapInPandas(_searcher(shared, similarity), schema)
        out = found if out is None else out.unionByName(found)
        if len(rows) < ITEM_BLOCK:
            break
        last, same = rows[-1], F.col("id").eqNullSafe(F.lit(rows[-1].id).cast("long")) & (F.col("text") > F.lit(rows[-1].text))
        block = asked.where(same | (F.col("id").isNotNull() if last.id is None else F.col("id") > last.id))
    return out if out is not None else spark.createDataFrame([], schema)


def _searcher(shared, similarity: float):
    def search(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, items = _worker_words(), shared.value
        for pdf in pdfs:
            texts, ids, out = pdf["text"].tolist(), pdf["id"].astype("Int64").tolist(), []
            for some, docs in _batches(texts, hashes):
                words, best = np.concatenate(some), {}
                starts = np.concatenate([[0], np.cumsum([len(w) for w in some])])
                for d, item, at, end in items.candidates(words, starts, similarity).tolist():
                    s = items.similarity(item, words[at:end])
                    if s >= similarity and s > best.get((d, item), (0.0,))[0]:
                        best[d, item] = (s, at - int(starts[d]), end - at)
                out += [(ids[docs[d]], items.ids[i], at, n, s) for (d, i), (s, at, n) in sorted(best.items())]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "start", "n_words", "similarity"]).astype({"doc_id": "Int64", "item_id": "Int64"})

    return search


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns. Rows without an
    id are searched too, and leave by their text's hash."""
    name = fresh(docs, "key")
    keyed = docs.withColumn(name, F.coalesce(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(0)))
    hit = matches(keyed, benchmark, similarity, name, text_col).select(F.col("doc_id").alias(name)).distinct()
    return keyed.join(hit, name, "left_anti").select(*docs.columns)
