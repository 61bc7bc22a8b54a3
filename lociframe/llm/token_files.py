"""Flat token-id files with 64-bit document offsets.

A part is three files: `.ids` (little-endian unsigned ids of its documents,
one after the other, 2 bytes wide if the vocabulary fits and else 4), `.off` (little-endian unsigned 64-bit, one
more than documents: where each starts within the part) and `.doc` (signed
64-bit document ids). A manifest row per part holds its place, its number of
documents and ids, the bytes of an id, and its base: the ids in all parts
before it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import END_ID, cut, encoder, shared_dir, shuffle_parts

#: Stands for a null doc_id in .doc files.
NO_ID = np.iinfo(np.int64).min
MANIFEST = "part int, path string, docs long, ids long, width int"


def _open(uri: str, mode: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        where.create_dir(os.path.dirname(path), recursive=True)
        return where.open_output_stream(path)
    return where.open_input_file(path)


def mapped(uri: str, kind: str) -> np.ndarray:
    """The file as an array: memory-mapped if local, else read."""
    local = uri[len("file://") :] if uri.startswith("file://") else uri if "://" not in uri else None
    if local is None:
        with _open(uri, "r") as f:
            return np.frombuffer(f.read(), dtype=kind)
    return np.memmap(local, dtype=kind, mode="r") if os.path.getsize(local) else np.zeros(0, dtype=kind)


def write_files(docs: DataFrame, out_dir: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Writes the files in ascending order of id; returns the manifest with bases.

    Null texts have no ids but the end id; null ids come first; rows that share
    an id each keep their place, ordered by text. A part is named after its
    task attempt, and only attempts in the (checkpointed) manifest count, so a
    lost executor or a second attempt never leaves half a file in the result.
    An empty table has an empty manifest. Other columns are ignored.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    n = parts or shuffle_parts(spark)

    def write(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, encode = TaskContext.get(), encoder(vocabulary)
        stem, kind = f"{out_dir}/{task.partitionId():05d}-{task.taskAttemptId()}", f"<u{encode.width}"
        end = np.array([END_ID], dtype=kind).tobytes()
        lengths, ids, f = [], [], None
        for pdf in rows:
            f = f or _open(f"{stem}.ids", "w")
            for text in pdf["text"]:
                got = np.frombuffer(encode.ids(text), dtype="<u4")
                f.write(got.astype(kind).tobytes() + end)
                lengths.append(len(got) + 1)
            ids.append(pdf["id"].fillna(NO_ID).to_numpy(dtype="<i8") if pdf["id"].isna().any() else pdf["id"].to_numpy(dtype="<i8"))
        if f is None:
            return
        f.close()
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
        for name, data in (("off", offsets), ("doc", np.concatenate(ids))):
            with _open(f"{stem}.{name}", "w") as g:
                g.write(data.tobytes())
        yield pd.DataFrame({"part": [task.partitionId()], "path": [stem], "docs": [len(lengths)], "ids": [int(offsets[-1])], "width": [encode.width]})

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # the text's beginning splits an id that very many rows share
    ordered = ordered.repartitionByRange(n, F.col("id"), F.substring("text", 1, 64)).sortWithinPartitions("id", "text")
    manifest = cut(ordered.mapInPandas(write, MANIFEST))
    # one row a part: at most `parts` rows reach the driver
    rows = sorted(manifest.collect())
    bases = np.concatenate([[0], np.cumsum([r.ids for r in rows], dtype=np.int64)])
    return spark.createDataFrame([(*r, int(b)) for r, b in zip(rows, bases, strict=False)], f"{MANIFEST}, base long")


def read_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for p in pdf.itertuples():
                ids, off, doc = mapped(f"{p.path}.ids", f"<u{p.width}"), mapped(f"{p.path}.off", "<u8"), mapped(f"{p.path}.doc", "<i8")
                for at in range(0, len(doc), 10_000):
                    some = off[at : at + 10_001].astype(np.int64)
                    crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(some[:-1].tolist(), some[1:].tolist(), strict=True)]
                    own = np.array(doc[at : at + 10_000])
                    yield pd.DataFrame({"doc_id": pd.array(own, dtype="Int64").copy() if (own != NO_ID).all() else pd.array([None if x == NO_ID else int(x) for x in own], dtype="Int64"), "start": some[:-1] + p.base, "n_tokens": np.diff(some), "ids_crc32": crcs})

    n = max(1, manifest.count())
    return manifest.repartition(n, "part").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, out_dir: str | None = None, **columns) -> DataFrame:
    """Writes every document's ids and reads the files back."""
    where = out_dir or f"{shared_dir(docs.sparkSession)}-tokens"
    return read_files(write_files(docs, where, vocabulary, **columns))
