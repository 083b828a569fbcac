"""Operator 9: best-fit decreasing with a segment tree over remaining capacities.

Best-fit decreasing looks only at lengths, and documents of equal length are
interchangeable. The job therefore counts pieces by length (at most ``capacity``
numbers, whatever the input), places whole runs of equal pieces on the driver - the
tree finds the tightest open bin in logarithmic time - and gives every piece its
bin by its rank among the pieces of its length. The result is the packing that
best-fit decreasing gives over the whole table, not one per partition.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, saved, steps, table, texts_of, tokenizer_path
from .encoding import encoder

CAPACITY, END_ID = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids binary"
#: Tokens of pieces that a worker hands over in one batch.
BATCH_TOKENS = 4_000_000


class Remaining:
    """A segment tree over the remaining capacities 0..capacity that open bins have."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def mark(self, room: int, is_open: bool) -> None:
        at = self.leaves + room
        self.open[at] = int(is_open)
        while at := at // 2:
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity, at least ``length``, that an open bin has."""
        at = self.leaves + length
        if self.open[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def place(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` pieces of each length.

    Returns runs (length, first rank, pieces a bin, first bin, offset): the pieces of
    that length from that rank on go to bins from the first, so many to each, from that
    offset on, up to the next run's first rank. A bin with room for several equal pieces
    is its own tightest bin until it has no more room, so whole blocks of bins with the
    same room fill at once. Runs depend on lengths and capacity only, not on the input's size.
    """
    rooms: dict[int, deque[tuple[int, int]]] = {}
    tree, runs, bins = Remaining(capacity), [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            rooms.setdefault(room, deque()).append((first, n))
            tree.mark(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                first, n, room = bins, -(-left // each), capacity
                bins += n
            else:
                first, n = rooms[room].popleft()
                if not rooms[room]:
                    tree.mark(room, False)
                each = room // length
            full = min(n, left // each)
            runs.append((length, rank, each, first, capacity - room))
            put(room - each * length, first, full)
            rank, left = rank + full * each, left - full * each
            if full < n and left:
                put(room - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            put(room if room < capacity else 0, first + full, n - full)
    return runs


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The token pieces of every text: whole documents, or pieces of ``capacity`` whose first may be shorter.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            ids, n = encoder(tokenizer).encode(texts_of(batch))
            ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            k = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), k)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
            head = (n - 1) % capacity + 1
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[doc], capacity)
            at, ids, doc_ids = np.concatenate([[0], np.cumsum(length)]), ids.astype("<u4", copy=False), batch.column("doc_id").cast(pa.int64())
            some = max(1, BATCH_TOKENS // capacity)
            for i in range(0, len(doc), some):
                part, ends = slice(i, i + some), at[i : i + some + 1]
                data = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * (ends - ends[0])).astype(np.int32)), pa.py_buffer(ids[ends[0] : ends[-1]])])
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(doc[part])), pa.array(piece[part].astype(np.int32)), pa.array(start[part]), pa.array(length[part]), data],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Packs all ``docs`` (doc_id, text; other columns are ignored) into sequences of ``capacity`` tokens.

    Null and empty texts are one end token. Rows with the same or no doc_id are packed each for
    itself. No rows give no rows. Pieces of one length are ranked in salted groups, so a third of
    all rows may have one length. A sequence is the ``ids`` of its pieces in order of ``offset``;
    they are encoded once, when the pieces are cut, and go with the piece to its place.
    """
    cut = saved(pieces(docs, tokenizer, capacity, end_id))
    salts = partitions(cut.sparkSession)
    cut = cut.select("*", F.pmod(F.xxhash64("doc_id", "piece", "_metadata.row_index"), F.lit(salts)).alias("salt"))  # a row's place in its file tells equal rows apart
    groups = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = groups.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs = place(counts, capacity)
    lengths, ranks, each, first, offset = (np.array(x, np.int64) for x in zip(*runs)) if runs else (np.empty(0, np.int64),) * 5
    order = np.lexsort((ranks, lengths))
    lengths, ranks, each, first, offset = (x[order] for x in (lengths, ranks, each, first, offset))
    keys = lengths << 44 | ranks

    @F.pandas_udf("sequence_id long, offset long")
    def at(length, rank):
        import pandas as pd

        length, rank = length.to_numpy(), rank.to_numpy()
        r = np.searchsorted(keys, length << 44 | rank, side="right") - 1
        k = rank - ranks[r]
        return pd.DataFrame({"sequence_id": first[r] + k // each[r], "offset": offset[r] + k % each[r] * length})

    rank = F.col("before") + F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids")) - 1
    placed = cut.join(before, ["length", "salt"]).withColumn("rank", rank).withColumn("at", at("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "at.sequence_id", "at.offset", "ids")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and digests; the digests are those of the packed ids, which the query leaves out."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")
