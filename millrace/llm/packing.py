"""Filling fixed-capacity containers with texts measured in tokens.

Sum-of-squares online packing: a level array counts the open containers by how full they are; each text goes to
the fill level whose choice leaves the smallest sum of squared counts of partially filled containers. Texts are
spread by a hash of their id over shards of about SHARD_ITEMS texts; each shard is packed on its own, in the order
of a second hash, with memory bounded by the capacity and the shard. Only (id, size) pairs are shuffled.

A text over the capacity is cut into full containers and a rest; every other text stays whole.

Defined results: null and empty texts have size 0 and go to their shard's first container, taking no space; equal
costs go to the fuller level; repeated rows are packed as often as they occur; an empty table gives an empty one;
columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CAPACITY = 2048
SHARD_ITEMS = 16384
#: Folder of the public vocabularies; MILLRACE_TOKENIZERS moves it.
TOKENIZERS = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
_encodings: dict[str, object] = {}


def encoding(path: str):
    """The byte-level tokenizer at path, loaded once a process."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def count_tokens(text: str, path: str) -> int:
    """Tokens of a whole text."""
    return len(encoding(path).encode_ordinary(text))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id, n_tokens) of every text; null counts 0."""
    path = tokenizer or f"{TOKENIZERS}/{VOCABULARY}"
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [count_tokens(t, path) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_tokens long").withColumnRenamed("id", id_col)


class Packer:
    """Sum-of-squares packing of one shard: counts by level, and a stack of open containers for each level."""

    def __init__(self, capacity: int):
        self.c = capacity
        self.n = np.zeros(capacity + 1, np.int64)  # n[h]: open containers filled to h; n[0] and n[capacity] stay 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> int:
        """The container that takes an item of this size, 1 <= size <= capacity."""
        c, n = self.c, self.n
        if size == c:
            self.made += 1
            return self.made - 1
        # level h to h + size changes the sum of squares by 2 (n[h+size] - n[h]) + 2, and by 1 - 2 n[h] where it fills up
        cost = 2 * (n[size + 1:] - n[1:c - size + 1]) + 2
        cost[-1] = 1 - 2 * n[c - size]
        cost[n[1:c - size + 1] == 0] = np.iinfo(np.int64).max
        best = cost[::-1].argmin()
        h = c - size - int(best)
        if cost[h - 1] < 2 * n[size] + 1:
            box = self.open[h].pop()
            n[h] -= 1
        else:
            h, box = 0, self.made
            self.made += 1
        if h + size < c:
            n[h + size] += 1
            self.open[h + size].append(box)
        return box


def pack(df: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, rows: int | None = None) -> DataFrame:
    """(id, piece, start, tokens, container) for sized items. rows: their number, counted if not given."""
    rows = df.count() if rows is None else rows
    shards = max(1, -(-rows // shard_items))
    kind = dict(df.dtypes)[id_col]
    src = (df.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"))
           .withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("o", F.hash("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, at = Packer(capacity), None
        for b in batches:
            take, piece, start, tokens, box = [], [], [], [], []
            for i, (s, shard) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if shard != at:
                    packer, at = Packer(capacity), shard
                base, full = shard << 40, s // capacity if s > capacity else 0
                for k in range(full):
                    take.append(i), piece.append(k), start.append(k * capacity), tokens.append(capacity), box.append(base + packer.place(capacity))
                rest = s - full * capacity
                if rest or not full:
                    take.append(i), piece.append(full), start.append(full * capacity), tokens.append(rest)
                    box.append(base + (packer.place(rest) if rest else 0))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                              pa.array(tokens, pa.int64()), pa.array(box, pa.int64())], names=["id", "piece", "start", "tokens", "container"])

    return (src.repartition(shards, "shard").sortWithinPartitions("shard", "o", "id")
            .mapInArrow(run, f"id {kind}, piece int, start long, tokens long, container long").withColumnRenamed("id", id_col))


def pack_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Texts measured and packed; the rows are counted on the bare table, not by measuring twice."""
    return pack(token_counts(df, id_col, text_col, tokenizer), id_col, "n_tokens", capacity, rows=df.count())
