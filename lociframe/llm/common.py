"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END_ID = 1
#: Entries a worker's word memo keeps at most, in two generations.
MEMO_WORDS = 600_000
#: Entries an encoder's memo of chunks keeps at most, likewise.
MEMO_CHUNKS = 1_200_000
#: Seconds from one garbage collection of tidy() to the next, and when the last was.
TIDY_S = 10.0
_TIDIED = [float("-inf")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Path of the public tokenizer file that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where a local session names none (tests), a temporary folder becomes its
    checkpoint folder; a cluster's executors would not share one.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        have = spark.sparkContext.getCheckpointDir()
        if not have and not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = have or f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        if not have:
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def tidy(spark: SparkSession) -> None:
    """Has the driver collect its garbage, every TIDY_S seconds at most.

    What a driver needs of an iteration is small, but the plans, results and
    task reports of finished steps fill its heap up to the limit before it
    collects them, and shuffle files and checkpoints that no step needs any
    more stay as long. A whole collection also gives heap back.
    """
    if time.monotonic() - _TIDIED[0] >= TIDY_S:
        spark.sparkContext._jvm.System.gc()
        _TIDIED[0] = time.monotonic()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage through a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    tidy(df.sparkSession)
    return out


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clear_names(df: DataFrame, *names: str) -> DataFrame:
    """Drops input columns that clash with names an operator adds."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have, out = {c.lower() for c in df.columns}, f"__{name}"
    while out in have:
        out += "_"
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over an unsigned array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Memo:
    """A bounded dict of two generations: when the young one is full it becomes
    the old one, and what is used again moves up, so frequent keys stay."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size // 2, {}, {}

    def room(self) -> None:
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}

    def missing(self, keys) -> list:
        """The distinct keys that neither generation has; the others are young."""
        young, old, out = self.young, self.old, []
        for k in set(keys):
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    out.append(k)
        return out


class WordHashes:
    """64-bit hashes of words (lower-cased bytes).

    normal: turns a word into what is hashed; its results are remembered.
    """

    def __init__(self, normal=None):
        import xxhash

        self._digest, self._normal, self._memo = xxhash.xxh3_64_intdigest, normal, Memo(MEMO_WORDS)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        digest = self._digest
        if self._normal is None:
            return np.array([digest(w) for w in words], dtype=np.uint64)
        memo = self._memo
        memo.room()
        young = memo.young
        try:
            found = [young[w] for w in words]
        except KeyError:
            for w in memo.missing(words):
                young[w] = digest(self._normal(w))
            found = [young[w] for w in words]
        return np.array(found, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; fewer words make one shingle."""
    k = len(word_hashes)
    if k == 0:
        return word_hashes
    m = min(n, k)
    out = np.zeros(k - m + 1, dtype=np.uint64)
    for i in range(m):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mix64(word_hashes[i : k - m + 1 + i])
    if k < n:
        out = out + np.uint64(k)
    return np.unique(mix64(out))


#: Chunks of these alone lower-case and normalise letter by letter.
PLAIN = re.compile(r"[\x21-\x7e\xc0-\xff]+")
#: The same of chunks with a space between them.
PLAIN_CHUNKS = re.compile(r"[\x20-\x7e\xc0-\xff]+")
#: The tokenizer file's pre-tokenizer, over lower-cased PLAIN text.
PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z\xdf-\xf6\xf8-\xff0-9]+")


class ChunkEncoder:
    """Encodes whole texts with the tokenizers library, word by word.

    The tokenizer file's pre-tokenizer never lets a token cross white space, so
    the ids of a text are the ids of its white-space separated chunks in order.
    The library encodes each distinct chunk once while it is remembered. A
    PLAIN chunk is first cut into its pre-tokens, which are shared by more
    chunks; the library encodes those with the same model and byte table. A
    pre-token is a chunk itself, so one memo holds both.
    ids() returns little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._tokenizer, self._bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self._bare.normalizer = normalizers.Sequence([])
        self._bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: Whether the file has the pre-tokenizer that PRETOKENS states.
        self._known = "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in self._tokenizer.to_str()
        #: Bytes that hold any id.
        self.width = 2 if self._tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self._memo = Memo(MEMO_CHUNKS)

    def ids(self, text: str | None) -> bytes:
        words = (text or "").encode("utf-8", "replace").split()
        self._memo.room()
        memo = self._memo.young
        found = list(map(memo.get, words))
        try:
            return b"".join(found)
        except TypeError:
            # only what the young generation lacks is looked at again
            gaps = [k for k, ids in enumerate(found) if ids is None]
            self._learn(self._memo.missing([words[k] for k in gaps]))
            for k in gaps:
                found[k] = memo[words[k]]
            return b"".join(found)

    def _learn(self, chunks: list[bytes]) -> None:
        if not chunks:
            return
        memo, plain, odd = self._memo.young, chunks, []
        text = b" ".join(chunks).decode("utf-8")
        if not (self._known and PLAIN_CHUNKS.fullmatch(text) and "<|" not in text):
            plain = []
            for w, word in zip(chunks, text.split(" "), strict=True):
                (plain if self._known and PLAIN.fullmatch(word) and "<|" not in word else odd).append(w)
            text = b" ".join(plain).decode("utf-8")
            for w, e in zip(odd, self._tokenizer.encode_batch([w.decode("utf-8") for w in odd], add_special_tokens=False), strict=True):
                memo[w] = np.array(e.ids, dtype="<u4").tobytes()
        if not plain:
            return
        # PLAIN text lower-cases letter by letter, so all chunks at once
        cut_up = [PRETOKENS.findall(word) for word in text.lower().split(" ")]
        new = self._memo.missing([p.encode("utf-8") for p in set(chain.from_iterable(cut_up))])
        if new:
            got = self._bare.encode(b" ".join(new).decode("utf-8"), add_special_tokens=False)
            ids, ends = np.array(got.ids, dtype="<u4").tobytes(), 4 * np.searchsorted(np.array(got.word_ids), np.arange(1, len(new) + 1))
            at = 0
            for p, end in zip(new, ends.tolist(), strict=True):
                memo[p], at = ids[at:end], end
        for w, ps in zip(plain, cut_up, strict=True):
            if w not in memo:
                memo[w] = b"".join([memo[p.encode("utf-8")] for p in ps])


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process, whatever tasks it runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): rows (id, component), component
    being the smallest id reachable; ids without a link are absent.

    Each round maps every vertex to the smallest vertex in its closed
    neighbourhood, follows that map to its fixed points by doubling, and
    rewrites the links through it. Only local minima are left, at most half of
    the vertices, so rounds and doublings are logarithmic, and a component ends
    as its smallest vertex. Only aggregates and joins run, so a vertex with very many links is no problem;
    rounds are cut by checkpoint(). Null ids and loops are ignored.
    """
    edges = cut(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a is not null and b is not null and a < b")
        .distinct()
    )
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("to")))
        while True:
            ahead = step.select(F.col("id").alias("to"), F.col("to").alias("far"))
            jumped = cut(step.join(ahead, "to").select("id", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
            step = jumped.select("id", "to")
            if jumped.where("moved").isEmpty():
                break
        maps.append(step)
        edges = cut(
            edges.join(step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a")
            .join(step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .where("a < b")
            .distinct()
        )
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    out = maps[0].select("id", F.col("to").alias("component"))
    for step in maps[1:]:
        nxt = step.select(F.col("id").alias("component"), "to")
        out = out.join(nxt, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return out
