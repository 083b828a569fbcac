"""Operator 2: token ids in wavelet-matrix shards.

File format: Parquet with one row a shard (``part``, ``shard`` order the shards;
``n_docs``, ``n_tokens``; ``data``), written by Spark's own committer, so a lost
executor leaves no half shard. ``data`` is one blob, little-endian:

    "WVM2" | bits u32 | n_tokens u64 | n_docs u64 | bytes of the documents' part u64
    | zeros of each plane u64[bits]
    | ones before each block of a plane, plane by plane u32[bits * (blocks + 1)]
    | where each block ends u32[bits * blocks]
    | documents, compressed: id known u8[n_docs], doc_id i64[n_docs], tokens u32[n_docs]
    | blocks of the planes, most significant plane first

A plane holds one bit of every token, in blocks of ``BLOCK`` bytes, each compressed
by Zstandard on its own, or stored as it is where that is no smaller; after each plane
the tokens with a 0 go before those with a 1, in order. Reading a token, counting and
looking up occurrences inflate one or two blocks a plane; the rest stays compressed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_rows, in_id_order, partitions, scratch, settled, steps, table, texts_of, tokenizer_path
from .encoding import encoder

END_ID = 2
#: A shard is closed at this many tokens; a longer document is a shard of its own.
SHARD_TOKENS = 1_000_000
#: Bytes of a plane that are compressed together, and between two stored counts of ones.
BLOCK = 16_384
SHARDS = "part int, shard int, n_docs long, n_tokens long, data binary"


class Plane:
    """A bit of every token: blocks of bytes, and the ones before each."""

    def __init__(self, blocks: Sequence[np.ndarray], ones: np.ndarray):
        self.blocks, self.ones = blocks, ones

    def bit(self, at: int) -> int:
        byte = at >> 3
        return int(self.blocks[byte // BLOCK][byte % BLOCK]) >> (7 - (at & 7)) & 1

    def rank(self, at: int) -> int:
        """Ones before a place."""
        byte = at >> 3
        block, rest = divmod(byte, BLOCK)
        n = int(self.ones[block])
        if rest or at & 7:
            data = self.blocks[block]
            n += int(np.bitwise_count(data[:rest]).sum())
            n += (int(data[rest]) >> (8 - (at & 7))).bit_count() if at & 7 else 0
        return n

    def select(self, bit: int, k: int, n: int) -> int:
        """Where the k-th (from 0) such bit of a plane of n bits is."""
        have = self.ones if bit else np.minimum(np.arange(len(self.ones)) * BLOCK * 8, n) - self.ones
        block = int(np.searchsorted(have, k, side="right")) - 1
        return block * BLOCK * 8 + int(np.flatnonzero(np.unpackbits(self.blocks[block]) == bit)[k - int(have[block])])

    def select_all(self, bit: int, ks: np.ndarray, n: int) -> np.ndarray:
        """The same of many, in ascending order: a block is unpacked once for all that lie in it."""
        have = self.ones if bit else np.minimum(np.arange(len(self.ones)) * BLOCK * 8, n) - self.ones
        blocks, out = np.searchsorted(have, ks, side="right") - 1, np.empty(len(ks), np.int64)
        begins = np.flatnonzero(np.diff(blocks, prepend=-1))
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(ks)]):
            block = int(blocks[begin])
            out[begin:end] = block * BLOCK * 8 + np.flatnonzero(np.unpackbits(self.blocks[block]) == bit)[ks[begin:end] - have[block]]
        return out


class Packed(Sequence):
    """The blocks of a plane in a file; each is inflated when it is asked for, and the last one is kept."""

    def __init__(self, data: memoryview, ends: np.ndarray, begin: int, size: int):
        self.data, self.ends, self.begin, self.size = data, ends, begin, size
        self.inflated, self.last = 0, (-1, None)

    def __len__(self) -> int:
        return len(self.ends)

    def __getitem__(self, i: int) -> np.ndarray:
        if i >= len(self):
            raise IndexError(i)
        if self.last[0] != i:
            raw = self.data[int(self.ends[i - 1]) if i else self.begin : int(self.ends[i])]
            size = min(BLOCK, self.size - i * BLOCK)
            if len(raw) < size:
                raw, self.inflated = ZSTD.decompress(raw, size), self.inflated + 1
            self.last = i, np.frombuffer(raw, np.uint8)
        return self.last[1]


class WaveletMatrix:
    """Access, rank (counting) and select (occurrence lookup) over a sequence of ids."""

    def __init__(self, n: int, planes: list[Plane], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.bits = len(planes)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        planes, zeros, rest = [], [], ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            bit = ((rest >> level) & 1).astype(np.uint8)
            plane = np.packbits(bit)
            blocks = [plane[i : i + BLOCK] for i in range(0, len(plane), BLOCK)]
            planes.append(Plane(blocks, np.concatenate([[0], np.cumsum([np.bitwise_count(b).sum(dtype=np.int64) for b in blocks], dtype=np.int64)])))
            bit = bit.view(bool)
            low = np.compress(~bit, rest)
            zeros.append(len(low))
            rest = np.concatenate([low, np.compress(bit, rest)])
        return cls(len(ids), planes, zeros)

    def access(self, at: int) -> int:
        value = 0
        for plane, zeros in zip(self.planes, self.zeros):
            bit, r = plane.bit(at), plane.rank(at)
            value = value << 1 | bit
            at = zeros + r if bit else at - r
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        begin = 0
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            a, b = plane.rank(begin), plane.rank(end)
            begin, end = (zeros + a, zeros + b) if value >> (self.bits - 1 - level) & 1 else (begin - a, end - b)
        return begin, end

    def rank(self, value: int, end: int) -> int:
        """How often ``value`` occurs before ``end``."""
        if value >> self.bits:
            return 0
        a, b = self._range(value, end)
        return b - a

    def select(self, value: int, k: int) -> int:
        """Where the k-th (from 0) occurrence of ``value`` is."""
        if value >> self.bits or not 0 <= k < self.rank(value, self.n):
            raise IndexError(k)
        at = self._range(value, self.n)[0] + k
        for plane, zeros in zip(reversed(self.planes), reversed(self.zeros)):
            at = plane.select(1, at - zeros, self.n) if at >= zeros else plane.select(0, at, self.n)
        return at

    def places(self, value: int) -> np.ndarray:
        """Where all occurrences of ``value`` are, in order. They lie side by side after the last plane, and in one half of each
        plane before, so they are taken up through the planes together."""
        if value >> self.bits or value < 0:
            return np.empty(0, np.int64)
        at = np.arange(*self._range(value, self.n), dtype=np.int64)
        for level, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            bit = value >> level & 1
            at = plane.select_all(bit, at - zeros if bit else at, self.n)
        return at

    def decode(self) -> np.ndarray:
        """The whole sequence, plane by plane from the last one up."""
        values = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(np.concatenate([np.empty(0, np.uint8), *self.planes[level].blocks]), count=self.n).view(bool)
            values[self.zeros[level] :] |= values.dtype.type(1 << (self.bits - 1 - level))
            above = np.empty_like(values)
            above[~bit], above[bit] = values[: self.zeros[level]], values[self.zeros[level] :]
            values = above
        return values.astype(np.uint32)


ZSTD = pa.Codec("zstd", 1)


def dump(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    m = WaveletMatrix.build(ids)
    documents = ZSTD.compress(np.array([d is not None for d in doc_ids], np.uint8).tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.asarray(lengths, "<u4").tobytes(), asbytes=True)
    blocks = [small if len(small := ZSTD.compress(b, asbytes=True)) < len(b) else b.tobytes() for p in m.planes for b in p.blocks]
    ones = np.concatenate([p.ones for p in m.planes])
    head = [
        b"WVM2", np.array([m.bits], "<u4").tobytes(), np.array([m.n, len(doc_ids), len(documents), *m.zeros], "<u8").tobytes(),
        ones.astype("<u4").tobytes(),
    ]
    begin = sum(map(len, head)) + 4 * len(blocks) + len(documents)
    ends = (begin + np.cumsum([len(b) for b in blocks], dtype=np.int64)).astype("<u4")
    return b"".join([*head, ends.tobytes(), documents, *blocks])


def load(blob: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """The documents' ids and numbers of tokens, and the matrix, whose blocks stay compressed until they are read."""
    data, at = memoryview(blob), 4
    if bytes(data[:4]) != b"WVM2":
        raise ValueError("not a wavelet-matrix shard")

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    bits = int(take("<u4", 1)[0])
    n, n_docs, n_bytes, *zeros = take("<u8", 3 + bits).tolist()
    size = -(-n // 8)
    n_blocks = -(-size // BLOCK)
    ones, ends = take("<u4", bits * (n_blocks + 1)).astype(np.int64).reshape(bits, -1), take("<u4", bits * n_blocks).reshape(bits, -1)
    documents = ZSTD.decompress(data[at : at + n_bytes], 13 * n_docs)
    known, doc_ids, lengths = np.frombuffer(documents, "u1", n_docs), np.frombuffer(documents, "<i8", n_docs, n_docs), np.frombuffer(documents, "<u4", n_docs, 9 * n_docs)
    begins = [at + n_bytes, *ends[:-1, -1].tolist()] if n_blocks else [at + n_bytes] * bits
    planes = [Plane(Packed(data, ends[k], begins[k], size), ones[k]) for k in range(bits)]
    return [d if k else None for d, k in zip(doc_ids.tolist(), known)], lengths.astype(np.int64), WaveletMatrix(n, planes, zeros)


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Writes the ids of all texts (null: empty), each with ``end_id`` after it, as shards in ascending doc_id order.

    Rows with the same doc_id stay next to each other in order of text; null doc_ids come
    first (many of them by hashes of their texts). Other columns are ignored. No rows write an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, doc_ids, lengths, ids = None, 0, [], [], []

        def close() -> pa.RecordBatch:
            whole = np.concatenate(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(doc_ids)]), pa.array([len(whole)]), pa.array([dump(doc_ids, np.concatenate(lengths), whole)])],
                ["part", "shard", "n_docs", "n_tokens", "data"],
            )

        for batch in steps(batches):
            got, n = encoder(tokenizer).encode(texts_of(batch))
            got, n = np.insert(got, np.cumsum(n), end_id), n + 1
            ends, keys, parts = np.cumsum(n), batch.column("doc_id").to_pylist(), batch.column("part").to_numpy()
            at = 0
            while at < len(keys):
                if doc_ids and (parts[at] != part or sum(map(len, ids)) + n[at] > SHARD_TOKENS):
                    yield close()
                    shard, doc_ids, lengths, ids = shard + 1, [], [], []
                if parts[at] != part:
                    part, shard = int(parts[at]), 0
                room = SHARD_TOKENS - sum(map(len, ids)) + (ends[at - 1] if at else 0)
                end = max(at + 1, int(np.searchsorted(ends, room, side="right")))
                end = min(end, at + int(np.argmax(np.append(parts[at:], -1) != part)))
                doc_ids += keys[at:end]
                lengths.append(n[at:end])
                ids.append(got[ends[at - 1] if at else 0 : ends[end - 1]])
                at = end
        if doc_ids:
            yield close()

    spark = settled(docs.sparkSession)
    parts = 4 * partitions(spark)
    placed, _ = in_id_order(docs.select(F.col("doc_id").cast("long"), "text"), parts)
    placed.repartition(partitions(spark), "part").sortWithinPartitions("part", "doc_id", "text").mapInArrow(run, SHARDS).write.option("compression", "none").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards at ``path``: doc_id, start, n_tokens and ids_crc32, all from the files."""
    shards = spark.read.schema(SHARDS).parquet(path)
    sizes = shards.select("part", "shard", "n_tokens")
    upto = 0
    starts = []
    for r in sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # one row a part, a fixed number
        starts.append((r["part"], upto))
        upto += r["n"]
    parts = spark.createDataFrame(starts, "part int, part_start long")
    in_part = F.sum("n_tokens").over(W.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    offsets = sizes.select("part", "shard", in_part.alias("in_part")).join(F.broadcast(parts), "part").select("part", "shard", (F.col("part_start") + F.col("in_part")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column("first").to_pylist(), batch.column("data")):
                doc_ids, n, matrix = load(data.as_buffer())
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(first + ends - n), pa.array(n), pa.array(crc_rows(matrix.decode(), ends))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.join(offsets, ["part", "shard"]).select("first", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def count_tokens(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """id and n: how often each id occurs in the shards at ``path``, by rank, without decoding them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                matrix = load(data.as_buffer())[2]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([matrix.rank(i, matrix.n) for i in ids], pa.int64())], ["id", "n"])

    return spark.read.schema(SHARDS).parquet(path).select("data").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """doc_id and position in its document of every occurrence of a token in the shards at ``path``, by select of all of a shard at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                doc_ids, n, matrix = load(data.as_buffer())
                ends, places = np.cumsum(n), matrix.places(token)
                for k in range(0, len(places), 10_000):
                    at = places[k : k + 10_000]
                    doc = np.searchsorted(ends, at, side="right")
                    yield pa.RecordBatch.from_arrays([pa.array([doc_ids[i] for i in doc.tolist()], pa.int64()), pa.array(at - (ends - n)[doc])], ["doc_id", "position"])

    return spark.read.schema(SHARDS).parquet(path).select("data").mapInArrow(run, "doc_id long, position long")


def op2_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write_shards(table(spark, sf_dir, "documents"), tokenizer_path(), path)
    return read_documents(spark, path)
