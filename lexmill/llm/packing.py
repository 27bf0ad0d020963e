"""Filling containers of fixed capacity with documents, by sum-of-squares online packing.

Documents are measured in tokens of a public tokenizer and dealt by hash to
shards of about a set number of documents; shards are packed side by side. Each
item goes to the fill level that makes the sum over levels of the squared
number of open containers smallest, tracked in one array per level, so no
level grows many half-filled containers. Equal choices go to the fullest.

Only a document larger than a container is split: into full containers and a
remainder, which is packed as an item.

Defined results: null and empty texts have no tokens and get no container;
specs with a null or non-positive capacity are left out; a repeated document
id, as a repeated spec, counts once.
"""

from __future__ import annotations

import base64
import functools
import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Vocabulary file of the tokenizer; its place is a parameter, never part of this repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Documents of a shard on average, about what one task packs at a time; the hash spreads them evenly.
SHARD_DOCS = 25_000
# Fixed value: how text is divided before byte pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PLACED = "pack_name string, capacity long, shard int, container string, doc_id long, piece int, token_start long, n_tokens long, offset long"


@functools.cache
def tokenizer(path: str):
    """The encoder of a vocabulary file of ranks, one per worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of each text, ids and counts alone; narrow."""
    source = df.where(F.length(text_col) > 0).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return source.mapInArrow(run, "doc_id long, n_tokens long")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container number and offset of each item, in the order given; no item exceeds the capacity."""
    open_at = np.zeros(capacity + 1, np.int64)  # open containers by fill level
    levels, n = np.empty(64, np.int64), 0  # the levels that have any, ascending
    held: dict[int, list[int]] = {}
    box, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    made = 0
    for k, size in enumerate(sizes.tolist()):
        top = capacity - size
        # Change of the sum of squares, halved; a full container counts nothing.
        best = open_at[size] + 0.5 if top else 0.0
        level = 0
        m = int(levels[:n].searchsorted(top, "right"))
        if m:
            used = levels[:m]
            cost = open_at[used + size] + 1.0 - open_at[used]
            if used[-1] == top:
                cost[-1] = 0.5 - open_at[top]
            at = m - 1 - int(cost[::-1].argmin())
            if cost[at] <= best:
                level = int(used[at])
        if level:
            b = held[level].pop()
            open_at[level] -= 1
            if not open_at[level]:
                levels[at : n - 1] = levels[at + 1 : n]
                n -= 1
        else:
            b, made = made, made + 1
        box[k], offset[k] = b, level
        new = level + size
        if new < capacity:
            if not open_at[new]:
                if n == len(levels):
                    levels = np.concatenate([levels, np.empty(n, np.int64)])
                p = int(levels[:n].searchsorted(new))
                levels[p + 1 : n + 1] = levels[p:n].copy()
                levels[p] = new
                n += 1
            open_at[new] += 1
            held.setdefault(new, []).append(b)
    return box, offset


def pack_documents(documents: DataFrame, specs: DataFrame, cut: Callable[[DataFrame], DataFrame], vocabulary: str = VOCABULARY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per document piece and spec, with its container and place in it.

    Texts are read once; the counts are written to the shared folder by
    ``cut``, as each capacity reads them. What is shuffled is three numbers per
    document and spec.
    """
    counts = cut(token_counts(documents, vocabulary=vocabulary).where("n_tokens > 0").dropDuplicates(["doc_id"]))
    shards = max(1, math.ceil(counts.count() / shard_docs))
    wanted = specs.where("capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity")).distinct().collect()
    if not wanted:
        return counts.sparkSession.createDataFrame([], PLACED)
    each = F.explode(F.array(*[F.struct(F.lit(r.pack_name).alias("pack_name"), F.lit(r.capacity).alias("capacity")) for r in wanted]))
    items = counts.withColumn("__spec", each).select("doc_id", "n_tokens", "__spec.*")
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    items = items.withColumn("full", F.floor((F.col("n_tokens") - 1) / F.col("capacity"))).withColumn("rest", F.col("n_tokens") - F.col("full") * F.col("capacity"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values("doc_id")
        box, offset = sum_of_squares(pdf["rest"].to_numpy(np.int64), capacity)
        return pd.DataFrame(
            {"pack_name": pdf["pack_name"], "capacity": capacity, "shard": pdf["shard"], "container": [f"{s}-{b}" for s, b in zip(pdf["shard"], box)], "doc_id": pdf["doc_id"], "piece": pdf["full"].astype("int32"), "token_start": pdf["full"] * capacity, "n_tokens": pdf["rest"], "offset": offset}
        )

    placed = items.groupBy("pack_name", "shard").applyInPandas(pack, PLACED)
    # Full pieces of split documents fill containers of their own.
    pieces = items.where("full > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"))
    own = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("piece").cast("string"))
    split = pieces.select("pack_name", "capacity", "shard", own.alias("container"), "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("n_tokens"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(split)
