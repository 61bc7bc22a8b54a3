"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Inputs of a word are an embedding of the word and the mean embedding of its
character four-grams (of UTF-8 bytes, with the word's ends marked). Words of
over WORD_BYTES bytes, as in text without spaces, are inputs piece by piece. A gated
recurrent network reads a window of WINDOW words in both directions, attention
pools its states and a linear unit scores the pool. Windows overlap by
WINDOW - STRIDE words and cover the whole text; a document scores as its
highest window. Everything is numpy, training included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_names, words_of
from .decontaminate import PUNCTUATION, normal

WINDOW, STRIDE = 48, 32
#: Word and four-gram rows, embedding size, states per direction.
WORD_ROWS, GRAM_ROWS, DIM, HIDDEN = 1 << 13, 1 << 14, 16, 8
#: Bytes of an input at most, and by how much the pieces of a longer part of a
#: word are apart.
WORD_BYTES, PIECE_STEP = 16, 8
#: Labelled documents a model is fitted on at most, by label, and the code
#: points of the longest one among them.
SAMPLE, SAMPLE_CHARS = {1: 1200, 0: 2400}, 20_000
EPOCHS, RANDOM_EPOCHS, BATCH, RATE = 20, 8, 64, 0.01
#: The last of EPOCHS whose parameters are averaged; the steps of a training at
#: least (few texts take more epochs, in the same parts); a toxic text's weight.
AVERAGED, LEAST_STEPS, POSITIVE_WEIGHT = 6, 300, 1.0
#: First spread of four-gram rows, the share of word and of four-gram rows that
#: a training step leaves out, and the pull of rows towards zero.
GRAM_SCALE, DROP_WORDS, DROP_GRAMS, DECAY = 0.1, 0.5, 0.2, 1e-3
#: Where a long word is parted.
BREAKS = re.compile(b"[" + re.escape(PUNCTUATION) + b"]+")
#: Rows of a worker's table of word inputs.
CACHE = 250_000
#: Windows that are read at once, in training (by the driver) and in scoring,
#: and words whose inputs are worked out at once.
RANKED_AT_ONCE, AT_ONCE, WORDS_AT_ONCE = 512, 4096, 8192


def pieces(word: bytes) -> list[bytes]:
    """A word of over WORD_BYTES bytes parted at its punctuation, and longer
    parts in overlapping pieces, so that no byte is left out."""
    word = normal(word)
    if len(word) <= WORD_BYTES:
        return [word]
    out = []
    for part in [x for x in BREAKS.split(word) if x] or [word]:
        last = max(0, len(part) - WORD_BYTES)
        out += [part[i : i + WORD_BYTES] for i in [*range(0, last, PIECE_STEP), last]]
    return out


def inputs_of(text: str | None) -> list[bytes]:
    """The words of a text, long ones in pieces."""
    words = words_of(text)
    if words and max(map(len, words)) > WORD_BYTES:
        return [x for w in words for x in (pieces(w) if len(w) > WORD_BYTES else (w,))]
    return words


def word_rows(words: list[bytes]) -> np.ndarray:
    """The embedding row of each word."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64).astype(np.int64) & (WORD_ROWS - 1)


def gram_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the four-grams of each word of at most WORD_BYTES bytes, and
    which of them exist."""
    wide = WORD_BYTES + 2
    raw = b"".join([(b"\x02" + w[:WORD_BYTES] + b"\x03").ljust(wide, b"\0") for w in words])
    m = np.frombuffer(raw, dtype=np.uint8).reshape(len(words), wide).astype(np.uint32)
    h = np.zeros((len(words), wide - 3), dtype=np.uint32)
    for i in range(4):
        h = h * np.uint32(0x01000193) + m[:, i : i + wide - 3] + np.uint32(1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    there = m[:, 3:] > 0
    there[:, 0] = True  # a short word has its first gram
    return (h & np.uint32(GRAM_ROWS - 1)).astype(np.int64), there


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class Network:
    """Parameters, forward and backward passes."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = lambda *s, k: (rng.standard_normal(s) * k).astype(np.float32)
        self.p = {
            "word": n(WORD_ROWS, DIM, k=0.01), "gram": n(GRAM_ROWS, DIM, k=GRAM_SCALE),
            "in": n(DIM, 6 * HIDDEN, k=0.3), "bias": np.zeros(6 * HIDDEN, dtype=np.float32),
            "rec": n(2, HIDDEN, 3 * HIDDEN, k=0.3), "att": n(2 * HIDDEN, k=0.3), "out": n(2 * HIDDEN, k=0.5), "base": np.array([-1.0], dtype=np.float32),
        }

    def inputs(self, words: list[bytes], rng: np.random.Generator | None = None) -> tuple[np.ndarray, tuple]:
        """Word inputs already multiplied into the gates (both directions).
        rng: for training, leaves out words' own rows and four-grams."""
        rows, (grams, there) = word_rows(words), gram_rows(words)
        k = there.sum(axis=1, keepdims=True).astype(np.float32)
        own = np.ones((len(words), 1), dtype=np.float32)
        if rng is not None:
            own = (rng.random((len(words), 1)) >= DROP_WORDS).astype(np.float32)
            there = there & (rng.random(there.shape) >= DROP_GRAMS)
        x = self.p["word"][rows] * own + (self.p["gram"][grams] * there[:, :, None]).sum(axis=1) / k
        return x @ self.p["in"] + self.p["bias"], (rows, grams, there, k, x, own)

    def gates(self, words: list[bytes]) -> np.ndarray:
        """inputs() of many words, some at a time: the four-grams of a word take
        many times the room of its gates."""
        out = np.empty((len(words), 6 * HIDDEN), dtype=np.float32)
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words[at : at + WORDS_AT_ONCE]
            out[at : at + len(some)] = self.inputs(some)[0]
        return out

    def forward(self, gates: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logits of windows. gates: (time, windows, 6 * HIDDEN); mask: (time,
        windows), None if all words exist."""
        T, B = gates.shape[:2]
        g = gates.reshape(T, B, 2, 3 * HIDDEN)
        h = np.zeros((2, B, HIDDEN), dtype=np.float32)
        states = np.zeros((T, 2, B, HIDDEN), dtype=np.float32)
        trace = []
        x = np.empty((2, B, 3 * HIDDEN), dtype=np.float32)
        for t in range(T):
            x[0], x[1] = g[t, :, 0], g[T - 1 - t, :, 1]
            u = h @ self.p["rec"]
            zr = _sigmoid(x[:, :, : 2 * HIDDEN] + u[:, :, : 2 * HIDDEN])
            z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
            c = np.tanh(x[:, :, 2 * HIDDEN :] + r * u[:, :, 2 * HIDDEN :])
            new = c + z * (h - c)
            if mask is not None:
                m = np.stack([mask[t], mask[T - 1 - t]])[:, :, None]
                new = np.where(m, new, h)
            if keep:
                trace.append((h, u, z, r, c))
            h = new
            states[t, 0], states[T - 1 - t, 1] = h[0], h[1]
        att = self.p["att"].reshape(2, HIDDEN)
        s = np.einsum("tdbh,dh->tb", states, att)
        if mask is not None:
            s = np.where(mask, s, -1e9)
        e = np.exp(s - s.max(axis=0))
        a = e / e.sum(axis=0)
        pool = np.einsum("tb,tdbh->bdh", a, states).reshape(B, 2 * HIDDEN)
        logits = pool @ self.p["out"] + self.p["base"]
        return (logits, (g, states, a, pool, trace)) if keep else logits

    def backward(self, dlogit: np.ndarray, kept: tuple, mask: np.ndarray | None) -> tuple[dict, np.ndarray]:
        """Gradients of the recurrent part, and those of the gates."""
        g, states, a, pool, trace = kept
        T, B = g.shape[:2]
        att = self.p["att"].reshape(2, HIDDEN)
        d = {"base": np.array([dlogit.sum()], dtype=np.float32), "out": pool.T @ dlogit, "rec": np.zeros_like(self.p["rec"])}
        dpool = (dlogit[:, None] * self.p["out"]).reshape(B, 2, HIDDEN)
        da = np.einsum("bdh,tdbh->tb", dpool, states)
        ds = a * (da - (a * da).sum(axis=0))
        if mask is not None:
            ds = np.where(mask, ds, 0)
        d["att"] = np.einsum("tb,tdbh->dh", ds, states).reshape(-1)
        dstates = np.einsum("tb,bdh->tdbh", a, dpool) + np.einsum("tb,dh->tdbh", ds, att)
        dgates = np.zeros_like(g)
        dh = np.zeros((2, B, HIDDEN), dtype=np.float32)
        rec_t = self.p["rec"].transpose(0, 2, 1)
        for t in reversed(range(T)):
            h, u, z, r, c = trace[t]
            dh = dh + np.stack([dstates[t, 0], dstates[T - 1 - t, 1]])
            if mask is not None:
                m = np.stack([mask[t], mask[T - 1 - t]])[:, :, None]
                through, dh = np.where(m, 0, dh), np.where(m, dh, 0)
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * u[:, :, 2 * HIDDEN :] * r * (1 - r)
            dx = np.concatenate([dz, dr, dc], axis=2)
            du = np.concatenate([dz, dr, dc * r], axis=2)
            dgates[t, :, 0], dgates[T - 1 - t, :, 1] = dx[0], dx[1]
            d["rec"] += h.transpose(0, 2, 1) @ du
            dh = dh * z + du @ rec_t
            if mask is not None:
                dh = dh + through
        return d, dgates.reshape(T, B, 6 * HIDDEN)


def window_starts(n: int) -> list[int]:
    """Where the windows of n words begin; the last one ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def windows_of(ids: np.ndarray, pad: int) -> np.ndarray:
    """(windows, WINDOW) of word ids, padded if the text is shorter."""
    if len(ids) <= WINDOW:
        return np.concatenate([ids, np.full(WINDOW - len(ids), pad, dtype=ids.dtype)])[None]
    return ids[np.array(window_starts(len(ids)))[:, None] + np.arange(WINDOW)]


# --- training -----------------------------------------------------------------


def fit(texts: list[str | None], labels: list[int], seed: int = 5) -> Network:
    """A network fitted on labelled texts, by Adam.

    A text is a bag of windows. The first epochs take random windows under the
    text's label; later ones the window that the network itself ranks highest.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in map(normal, inputs_of(t))], dtype=np.int32) for t in texts]
    kept = [(d, float(y)) for d, y in zip(docs, labels, strict=True) if len(d)]
    if not kept or len({y for _, y in kept}) < 2:
        share = np.clip(np.mean(labels) if labels else 0.5, 0.01, 0.99)
        net.p["out"][:] = 0
        net.p["base"][:] = np.log(share / (1 - share))
        return net
    words, pad = [*vocabulary], len(vocabulary)
    bags = [windows_of(d, pad) for d, _ in kept]
    y = np.array([v for _, v in kept], dtype=np.float32)
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    every = np.concatenate(bags)
    first = np.searchsorted(owner, np.arange(len(bags)))
    count = np.bincount(owner)
    n = len(bags)
    del docs, kept, bags, vocabulary
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, weight = 0, np.where(y > 0, min(POSITIVE_WEIGHT, 0.3 / max(y.mean(), 0.02)), 1.0).astype(np.float32)
    # few texts are gone through more often
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // n))
    mean, seen = {k: v.copy() for k, v in net.p.items()}, 0
    for epoch in range(epochs):
        random = first + (rng.random(n) * count).astype(np.int64)
        chosen, who = [random], [np.arange(n)]
        if epoch >= epochs * RANDOM_EPOCHS // EPOCHS:
            logits = _all_logits(net, words, every, pad)
            order = np.lexsort((-logits, owner))
            best = order[np.searchsorted(owner[order], np.arange(n))]
            chosen, who = [best, random[y == 0]], [np.arange(n), np.flatnonzero(y == 0)]
        chosen, who = np.concatenate(chosen), np.concatenate(who)
        shuffled = rng.permutation(len(chosen))
        rate = RATE * (0.3 if epoch >= epochs - 3 else 1.0)
        for at in range(0, len(shuffled), BATCH):
            pick = shuffled[at : at + BATCH]
            step += 1
            _step(net, words, every[chosen[pick]], y[who[pick]], weight[who[pick]], pad, moment, step, rate, rng)
            if epoch >= epochs - epochs * AVERAGED // EPOCHS:
                seen += 1
                for k, v in net.p.items():
                    mean[k] += (v - mean[k]) / seen
    net.p = mean
    return net


def _lookup(net: Network, words: list[bytes], ids: np.ndarray, pad: int, rng: np.random.Generator):
    used, place = np.unique(ids, return_inverse=True)
    place = place.reshape(ids.shape)
    real = [words[i] if i < pad else b"" for i in used.tolist()]
    gates, kept = net.inputs(real, rng)
    mask = ids != pad
    return gates, kept, place, None if mask.all() else mask.T


def _all_logits(net: Network, words: list[bytes], every: np.ndarray, pad: int) -> np.ndarray:
    gates = net.gates([*words, b""])
    out = []
    for at in range(0, len(every), RANKED_AT_ONCE):
        ids = every[at : at + RANKED_AT_ONCE].T
        mask = ids != pad
        out.append(net.forward(gates[ids], None if mask.all() else mask))
    return np.concatenate(out)


def _step(net, words, ids, y, weight, pad, moment, step, rate, rng) -> None:
    gates, (rows, grams, there, k, x, own), place, mask = _lookup(net, words, ids, pad, rng)
    logits, kept = net.forward(gates[place.T], mask, keep=True)
    dlogit = ((_sigmoid(logits) - y) * weight / len(y)).astype(np.float32)
    d, dgates = net.backward(dlogit, kept, mask)
    if mask is not None:
        dgates = dgates * mask[:, :, None]
    per_word = np.zeros_like(gates)
    np.add.at(per_word, place.T.reshape(-1), dgates.reshape(-1, dgates.shape[2]))
    d["bias"], d["in"] = per_word.sum(axis=0), x.T @ per_word
    dx = per_word @ net.p["in"].T
    d["word"] = np.zeros_like(net.p["word"])
    np.add.at(d["word"], rows, dx * own)
    d["gram"] = np.zeros_like(net.p["gram"])
    np.add.at(d["gram"], grams[there], np.repeat(dx / k, there.sum(axis=1), axis=0))
    for name, value in net.p.items():
        m, v = moment[name]
        grad = np.clip(d[name], -1, 1) + (DECAY * value if name in ("word", "gram") else 0)
        m += 0.1 * (grad - m)
        v += 0.005 * (grad * grad - v)
        value -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.995**step)) + 1e-7)).astype(np.float32)


# --- scoring --------------------------------------------------------------------


class Scorer:
    """Scores texts; keeps a bounded table of word inputs in a worker."""

    def __init__(self, net: Network):
        self.net, self.rows = net, {}
        self.table = np.zeros((CACHE + 1, 6 * HIDDEN), dtype=np.float32)

    def _ids(self, words: list[bytes]) -> np.ndarray:
        rows = self.rows
        try:
            return np.array([rows[w] for w in words], dtype=np.int64)
        except KeyError:
            new = [w for w in set(words) if w not in rows]
            for at in range(0, len(new), 20_000):
                some = new[at : at + 20_000]
                first = len(rows) + 1
                self.table[first : first + len(some)] = self.net.inputs([normal(w) for w in some])[0]
                for k, w in enumerate(some, first):
                    rows[w] = k
            return np.array([rows[w] for w in words], dtype=np.int64)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Of 0 to 1; a text without words scores as the empty pool does."""
        out = np.full(len(texts), float(_sigmoid(np.minimum(self.net.p["base"][0], -1.0))))
        best = np.full(len(texts), -np.inf)
        whole, short = ([], []), ([], [])
        waiting = 0

        def flush() -> None:
            nonlocal waiting
            for (parts, owners), masked in ((whole, False), (short, True)):
                if parts:
                    ids, own = np.concatenate(parts).T, np.concatenate(owners)
                    for at in range(0, ids.shape[1], AT_ONCE):
                        some = np.ascontiguousarray(ids[:, at : at + AT_ONCE])
                        np.maximum.at(best, own[at : at + AT_ONCE], self.net.forward(self.table[some], some > 0 if masked else None))
                    parts.clear()
                    owners.clear()
            waiting = 0

        for k, text in enumerate(texts):
            words = inputs_of(text)
            # a very long text is read in pieces that the windows overlap
            for at in range(0, len(words), STRIDE * 512):
                piece = words[at : at + STRIDE * 512 + WINDOW]
                if at and len(piece) <= WINDOW and at + len(piece) == len(words):
                    piece = words[-WINDOW:]
                if len(self.rows) + len(piece) >= CACHE:
                    flush()
                    self.rows.clear()
                w = windows_of(self._ids(piece), 0)
                parts, owners = short if len(piece) < WINDOW else whole
                parts.append(w)
                owners.append(np.full(len(w), k))
                waiting += len(w)
            if waiting >= AT_ONCE:
                flush()
        flush()
        seen = np.isfinite(best)
        out[seen] = _sigmoid(np.clip(best[seen], -40, 40))
        return out


_SCORERS: dict[int, Scorer] = {}


def held_out(id_col) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """Fits on a bounded sample (SAMPLE documents a label, of SAMPLE_CHARS code
    points at most) of the labelled rows that are not held out, chosen by a
    hash of the id. Null ids and labels are ignored; of several labels of an id
    the highest counts. Without both labels in the sample the network scores
    every text alike."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).where(F.char_length("__text") <= SAMPLE_CHARS)
    lists = []
    for y, n in SAMPLE.items():
        # twice as many ids as documents, as some may be long or absent
        ids = known.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(2 * n)
        lists.append(ids)
    ids = lists[0].unionByName(lists[1])
    found = texts.join(F.broadcast(ids), "__id")
    rows = []
    for y, n in SAMPLE.items():
        rows += found.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id", "__text").limit(n).collect()
    return fit([r["__text"] for r in rows], [r["__y"] for r in rows])


def score(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """Adds score and predicted (1 if score >= 0.5). Nulls and empty texts get
    the score of no words (under 0.5); input columns of these names are
    replaced; the text alone decides."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = id(shared.value)
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(_SCORERS[key].scores(texts.tolist()))

    out = clear_names(docs, *[c for c in ("score", "predicted") if c != text_col])
    out = out.withColumn("score", run(F.col(text_col).cast("string")))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))
