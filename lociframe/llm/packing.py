"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Pieces are dealt to blocks of bounded size at random. Each block is evolved on
several islands at once, in separate tasks; after an epoch every island's best
solution migrates to the next island of its block. The bins that the best
solution leaves ill filled are released, dealt anew to fewer blocks and
packed again.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import END_ID, clear_names, cut, encoder

SEQUENCE = 4096
#: Pieces in a block on average.
BLOCK = 3000
ISLANDS = 2
EPOCHS = 2
POPULATION = 12
#: Children in a row that are no better than the best before an island stops.
OFFSPRING = 60
#: Bins filled less than this share are packed again in the next level.
WELL_FILLED = 0.995
LEVELS = 3
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut at `size`.

    A null or empty text is the end id alone. Only documents longer than
    `size` have more than one piece.
    """

    def cut_up(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(vocabulary), np.array([END_ID], dtype="<u4").tobytes()
        for pdf in rows:
            out = []
            for doc, text in zip(pdf["id"].astype("Int64"), pdf["text"], strict=True):
                ids = encode.ids(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInPandas(cut_up, PIECES)


# --- the algorithm over one block: lengths in descending order -> bins -------


def best_fit(lengths: np.ndarray, items: np.ndarray, bins: list[list[int]], rooms: list[int], size: int) -> None:
    """Adds items (in the given order) each to the fullest bin that has room."""
    free = sorted((r, b) for b, r in enumerate(rooms) if r > 0)
    for i, need in zip(items.tolist(), lengths[items].tolist(), strict=True):
        at = bisect_left(free, (need, -1))
        if at == len(free):
            bins.append([i])
            room, b = size - need, len(bins) - 1
            rooms.append(room)
        else:
            room, b = free.pop(at)
            bins[b].append(i)
            room -= need
            rooms[b] = room
        if room > 0:
            insort(free, (room, b))


def pack(lengths: np.ndarray, order: np.ndarray, size: int) -> list[list[int]]:
    bins: list[list[int]] = []
    best_fit(lengths, order, bins, [], size)
    return bins


def flat(bins: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All items, bin by bin, and the bin of each."""
    counts = np.fromiter(map(len, bins), dtype=np.int64, count=len(bins))
    return np.fromiter(chain.from_iterable(bins), dtype=np.int64, count=int(counts.sum())), np.repeat(np.arange(len(bins)), counts)


def filled(lengths: np.ndarray, bins: list[list[int]]) -> np.ndarray:
    """The tokens in each bin."""
    items, owner = flat(bins)
    # sums below 2^53 are exact as doubles
    return np.bincount(owner, lengths[items], len(bins)).astype(np.int64)


def fitness(lengths: np.ndarray, bins: list[list[int]], size: int) -> tuple[int, float]:
    """Fewer bins first, then bins filled unevenly (some full, some to spare)."""
    fills = filled(lengths, bins) / size
    return (-len(bins), float((fills**2).sum()))


def crossover(lengths: np.ndarray, one: list[list[int]], two: list[list[int]], size: int, rng: np.random.Generator) -> list[list[int]]:
    """Injects whole well-filled bins of `two` into `one`, drops the bins of
    `one` that share an item with them, and best-fits the displaced items."""
    ranked = np.argsort(-filled(lengths, two), kind="stable")
    good = ranked[: max(1, len(two) // 2)]
    injected = [two[k] for k in good[rng.random(len(good)) < 0.5]]
    inside = np.zeros(len(lengths), dtype=bool)
    inside[flat(injected)[0]] = True
    items, owner = flat(one)
    shared = np.bincount(owner, inside[items], len(one)) > 0
    child = [list(b) for b in injected]
    fresh = rng.random(len(one)) < 0.05  # mutation: a few bins are emptied
    broken = fresh | shared
    displaced = items[broken[owner] & ~inside[items]]
    child += [list(b) for b, gone in zip(one, broken.tolist(), strict=True) if not gone]
    rooms = (size - filled(lengths, child)).tolist()
    best_fit(lengths, np.sort(displaced), child, rooms, size)
    return child


def as_labels(bins: list[list[int]], n: int) -> list[int]:
    out = np.zeros(n, dtype=np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out.tolist()


def as_bins(labels) -> list[list[int]]:
    labels = np.asarray(labels)
    order = np.argsort(labels, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1)] if len(labels) else []


def evolve(lengths: np.ndarray, seeds: list, size: int, seed: int, population: int = POPULATION, offspring: int = OFFSPRING) -> list[list[int]]:
    """The best solution after one epoch on an island; seeds: labels to start
    from. An epoch ends at the lower bound, or when `offspring` children in a
    row were no better than the best."""
    rng, n = np.random.default_rng(seed), len(lengths)
    least = -(-int(lengths.sum()) // size)
    people = [as_bins(s) for s in seeds] or [pack(lengths, np.arange(n), size)]
    while len(people) < population and len(people[0]) > least:
        # nearly descending orders: lengths blurred by some noise
        people.append(pack(lengths, np.argsort(-lengths * (1 + 0.2 * rng.random(n)), kind="stable"), size))
    rated = sorted(((fitness(lengths, p, size), k, p) for k, p in enumerate(people)), key=lambda x: (x[0], -x[1]), reverse=True)
    k = idle = 0
    while idle < offspring and len(rated[0][2]) > least and len(rated) > 1:
        a, b = rng.choice(len(rated), 2, replace=False)
        child = crossover(lengths, rated[a][2], rated[b][2], size, rng)
        fit = fitness(lengths, child, size)
        k, idle = k + 1, 0 if fit > rated[0][0] else idle + 1
        rated.append((fit, population + k, child))
        rated = sorted(rated, key=lambda x: (x[0], -x[1]), reverse=True)[:population]
    return rated[0][2]


# --- over all blocks -----------------------------------------------------------


def _epoch(states: DataFrame, size: int, epoch: int) -> DataFrame:
    """states: block, island, lengths, seeds (solutions). Returns block,
    island, lengths, best, n_bins, fit."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = []
            for r in pdf.itertuples():
                lengths = np.asarray(r.lengths, dtype=np.int64)
                bins = evolve(lengths, list(r.seeds), size, (r.block * ISLANDS + r.island) * EPOCHS + epoch)
                out.append((r.block, r.island, r.lengths, as_labels(bins, len(lengths)), len(bins), fitness(lengths, bins, size)[1]))
            yield pd.DataFrame(out, columns=["block", "island", "lengths", "best", "n_bins", "fit"])

    return states.mapInPandas(run, "block long, island int, lengths array<int>, best array<int>, n_bins int, fit double")


def _solve(dealt: DataFrame, blocks: int, size: int) -> DataFrame:
    """dealt: rows with block and length. Returns them with bin and offset."""
    lens = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.col("length").cast("int")), asc=False).alias("lengths"))
    tasks = max(1, min(blocks * ISLANDS, 4096))
    state = lens.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumn("seeds", F.expr("cast(array() as array<array<int>>)"))
    state = state.repartition(tasks, "block", "island")
    for epoch in range(EPOCHS):
        best = cut(_epoch(state, size, epoch))
        if epoch < EPOCHS - 1:
            # the elite stays, and a copy of it goes to the next island
            moved = best.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))
            state = best.unionByName(moved).repartition(tasks, "block", "island").groupBy("block", "island").agg(F.first("lengths").alias("lengths"), F.collect_list("best").alias("seeds"))
    won = best.groupBy("block").agg(F.max_by("best", F.struct(-F.col("n_bins"), "fit", -F.col("island"))).alias("best"))

    def place(key, mine: pd.DataFrame, solution: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        mine["bin"] = np.asarray(solution["best"].iloc[0], dtype=np.int64)
        mine = mine.sort_values(["bin", "length"], ascending=[True, False], kind="stable")
        sums = mine.groupby("bin")["length"]
        mine["offset"] = sums.cumsum() - mine["length"]
        mine["fill"] = sums.transform("sum")
        return mine[["doc_id", "piece", "start", "length", "ids_crc32", "block", "bin", "offset", "fill"]].astype({"doc_id": "Int64"})

    return dealt.groupBy("block").cogroup(won.groupBy("block")).applyInPandas(place, f"{PIECES}, block long, bin long, offset long, fill long")


def pack_pieces(parts: DataFrame, size: int = SEQUENCE, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to pieces (PIECES columns).

    Rows are dealt to blocks by a seeded random number over a checkpointed
    table, so equal rows don't meet in one block. An empty table stays empty.
    sequence_id is unique: level, block and bin are parts of it.
    """
    # pieces that fill a sequence need no packing; they are dealt like the rest
    left, done = cut(parts), []
    for level in range(LEVELS):
        n = left.count()
        if not n:
            break
        blocks = -(-n // block)
        last = blocks == 1 or level == LEVELS - 1
        dealt = cut(left.withColumn("block", F.floor(F.rand(level) * blocks)))
        packed = cut(_solve(dealt, blocks, size))
        packed = packed.withColumn("sequence_id", (F.lit(level << 58) + F.shiftleft("block", 24) + F.col("bin")).cast("long"))
        keep = F.lit(True) if last else F.col("fill") >= WELL_FILLED * size
        done.append(packed.where(keep).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
        if last:
            break
        left = cut(packed.where(~keep).select("doc_id", "piece", "start", "length", "ids_crc32"))
    if not done:
        return left.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE) -> DataFrame:
    """Packs whole documents into sequences of at most `size` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. Nulls and empty texts are single end ids; repeated
    rows are packed each; other columns are ignored; a null id stays null.
    """
    clean = clear_names(docs, *[c for c in ("id",) if c not in (id_col, text_col)])
    return pack_pieces(pieces(clean, vocabulary, id_col, text_col, size), size)
