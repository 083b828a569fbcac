"""Operator 10: SentencePiece encoding and decoding with the tokenizers library.

``read_model`` parses the model's protobuf, ``Pieces`` rebuilds it from parts of the
tokenizers library: the character map and white-space rules of the normaliser, the
metaspace marker, unigram scores - or, for a BPE model, merges in order of their
pieces' scores - and byte fallback. No piece holds a marker after another
character, so a text's ids are those of its units (markers and what follows them);
each distinct unit is encoded once, in multithreaded batches.

Parity is verified for every document: the model's own library normalises every text,
and encodes every distinct unit; where either differs from what is rebuilt, it encodes
the whole document, which decides.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, steps, table, texts_of, tokenizer_path

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MEMO_UNITS, STEP = 300_000, 2_000_000


@dataclass(frozen=True)
class Spec:
    pieces: tuple[tuple[str, float, int], ...]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown_surface: str = " ⁇ "
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message; sub-messages and strings are bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
            continue
        if wire not in (1, 2, 5):
            raise ValueError(f"wire type {wire} is not one of a model's")
        size = {1: 8, 5: 4}.get(wire) or varint() if wire != 2 else varint()
        yield number, data[at : at + size]
        at += size


def read_model(data: bytes) -> Spec:
    """The parts of a model file: pieces (1), trainer (2) and normaliser (3)."""
    pieces, got = [], {}
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
            got |= {"kind": trainer.get(3, UNIGRAM), "byte_fallback": bool(trainer.get(35, 0))}
            if 44 in trainer:
                got["unknown_surface"] = trainer[44].decode()
            if trainer.get(24, 0):
                raise ValueError("white space as a suffix is not rebuilt")
        elif number == 3:
            norm = dict(fields(value))
            got |= {"charsmap": norm.get(2, b""), "dummy_prefix": bool(norm.get(3, 1)), "remove_extra": bool(norm.get(4, 1)), "escape": bool(norm.get(5, 1))}
    return Spec(tuple(pieces), **got)


class Surfaces:
    """Decodes as the model's own library does."""

    def __init__(self, spec: Spec):
        self.spec = spec
        surfaces = [self._surface(p, t) for p, _, t in spec.pieces]
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.surface_at = np.concatenate([[0], np.cumsum([len(x) for x in surfaces], dtype=np.int64)])

    def _surface(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return {UNKNOWN: self.spec.unknown_surface.encode(), CONTROL: b""}.get(kind, piece.replace(MARK, " ").encode())

    def decode_many(self, ids: np.ndarray, n: np.ndarray) -> list[str]:
        """The texts of rows of ``n`` ids each, which stand one after another."""
        begin = self.surface_at[ids]
        length = self.surface_at[ids + np.uint32(1)] - begin
        upto = np.concatenate([[0], np.cumsum(length)])
        data = self.surface[np.repeat(begin - upto[:-1], length) + np.arange(upto[-1])].tobytes()
        ends = upto[np.concatenate([[0], np.cumsum(n)])].tolist()
        skip = self.spec.dummy_prefix
        return [data[a + (skip and data[a : a + 1] == b" " and a < b) : b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_many(np.asarray(ids, np.uint32), np.array([len(ids)]))[0]


class Pieces(Surfaces):
    """Encodes and decodes as the model's own library does, and verifies it if given that library's processor."""

    def __init__(self, spec: Spec, own=None):
        super().__init__(spec)
        self.own = own
        # As many threads as the task has cores; a cluster sets RAYON_NUM_THREADS with spark.task.cpus.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", os.environ.get("OMP_NUM_THREADS", "1"))
        from tokenizers import Tokenizer, models, normalizers

        if spec.kind not in (UNIGRAM, BPE) or not spec.escape or any(t == USER_DEFINED for *_, t in spec.pieces):
            raise ValueError("only unigram and BPE models with escaped white space and without user-defined pieces are rebuilt")
        usable = [t in (NORMAL, UNKNOWN, BYTE) for *_, t in spec.pieces]
        if any(re.search(f"[^{MARK}]{MARK}", p) for (p, *_), u in zip(spec.pieces, usable) if u):
            raise ValueError("a piece goes on after white space; texts can't be cut there")
        unknown = next((i for i, (*_, t) in enumerate(spec.pieces) if t == UNKNOWN), None)
        if spec.kind == UNIGRAM:
            # Control and unused pieces never match text: a score under all others keeps them in place and out of use.
            vocab = [(p if u else f"{i}", s if u else -1e9) for i, ((p, s, _), u) in enumerate(zip(spec.pieces, usable))]
            self.tokenizer = Tokenizer(models.Unigram(vocab, unknown, spec.byte_fallback))
        else:
            scores = {p: s for p, s, t in spec.pieces if t == NORMAL}
            ids = {p: i for i, (p, *_) in enumerate(spec.pieces)}
            merges = [(-s, ids[p], p[:k], p[k:]) for p, s in scores.items() for k in range(1, len(p)) if p[:k] in scores and p[k:] in scores]
            merges.sort(key=lambda m: (m[0], ids[m[2]], ids[m[3]]))
            self.tokenizer = Tokenizer(models.BPE({p: i for i, (p, *_) in enumerate(spec.pieces)}, [(a, b) for *_, a, b in merges], unk_token=None if unknown is None else spec.pieces[unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback))
        self.characters = normalizers.Precompiled(spec.charsmap) if spec.charsmap else None
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.odd = np.zeros(0, bool)

    def _unlike(self, units: list[str], found: list[list[int]]) -> list[bool]:
        """Whether the own library encodes each unit otherwise. It adds the first marker itself."""
        given = [(u[1:] if self.spec.dummy_prefix else u).replace(MARK, " ") for u in units]
        return [a != b for a, b in zip(self.own.encode(given, num_threads=1), found)]

    def normalised(self, text: str) -> str:
        if self.characters is not None:
            text = self.characters.normalize_str(text)
        if self.spec.remove_extra:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        text = ((" " if self.spec.dummy_prefix else "") + text).replace(" ", MARK)
        return text.rstrip(MARK) if self.spec.remove_extra else text  # a text's own markers at its end go too

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and each text's number of ids."""
        return self._encode([self.normalised(t) for t in texts])[:2]

    def verified(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """The same, and whether the own library gives each text the same ids."""
        ready = [self.normalised(t) for t in texts]
        ids, n, odd = self._encode(ready)
        same = [not o and self.own.normalize(t) == r for o, t, r in zip(odd.tolist(), texts, ready)]
        if not all(same):
            rows = np.split(ids, np.cumsum(n)[:-1])
            same = [s or self.own.encode(t, num_threads=1) == r.tolist() for s, t, r in zip(same, texts, rows)]
        return ids, n, same

    def _encode(self, ready: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chars = np.array([len(t) for t in ready], np.int64)
        if not chars.sum():
            return np.empty(0, np.uint32), np.zeros(len(ready), np.int64), np.zeros(len(ready), bool)
        joined = "".join(ready)
        points, data = np.frombuffer(joined.encode("utf-32-le"), np.uint32), joined.encode()
        ends = np.cumsum(chars)
        first = np.zeros(len(points), bool)
        first[(ends - chars)[chars > 0]] = True
        mark = points == ord(MARK)
        first[1:] |= mark[1:] & ~mark[:-1]
        starts = np.flatnonzero(first)
        wide = np.cumsum(points >= 0x80, dtype=np.int32) + np.cumsum(points >= 0x800, dtype=np.int32) + np.cumsum(points >= 0x10000, dtype=np.int32)
        offsets = np.append(starts + np.where(starts > 0, wide[starts - 1], 0), len(data)).astype(np.int32)
        units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        known, codes = units.dictionary.to_pylist(), units.indices.to_numpy()
        if len(self.memo) + len(known) > MEMO_UNITS:
            self._forget()
        if new := [u for u in known if u not in self.memo]:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            base = len(self.ends) - 1
            self.memo.update(zip(new, range(base, base + len(new))))
            self.ids = np.concatenate([self.ids, np.fromiter((i for f in found for i in f), np.uint32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(f) for f in found])])
            self.odd = np.concatenate([self.odd, np.array(self._unlike(new, found) if self.own else np.zeros(len(new)), bool)])
        rows = np.fromiter(map(self.memo.__getitem__, known), np.int64, len(known))[codes]
        begin, length = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
        upto = np.cumsum(length)
        ids = self.ids[np.repeat(begin - (upto - length), length) + np.arange(upto[-1])]
        at = np.searchsorted(starts, np.concatenate([[0], ends]))
        odd = np.diff(np.concatenate([[0], np.cumsum(self.odd[rows])])[at]) > 0
        return ids, np.diff(np.concatenate([[0], upto])[at]), odd


@lru_cache(2)
def pieces_of(path: str, verify: bool = False) -> Pieces:
    own = None
    if verify:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        return Pieces(read_model(f.read()), own)


@lru_cache(2)
def surfaces_of(path: str) -> Surfaces:
    with open(path, "rb") as f:
        return Surfaces(read_model(f.read()))


def _binary(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], 4 * np.cumsum(n)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


def _encoded(docs: DataFrame, model: str, more: dict[str, str]) -> DataFrame:
    """``docs`` with ids and the columns ``more``: those of ``round_trip``, in one pass of the workers."""
    settled(docs.sparkSession)
    docs = docs.drop("ids", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rebuilt = pieces_of(model, "parity" in more)
        for batch in steps(batches, chars=STEP):
            if "parity" in more:
                ids, n, same = rebuilt.verified(texts_of(batch))
                made = [pa.array(rebuilt.decode_many(ids, n), pa.string()), pa.array(same, pa.bool_())]
            else:
                (ids, n), made = rebuilt.encode(texts_of(batch)), []
            yield pa.RecordBatch.from_arrays([*batch.columns, _binary(ids, n), *made], [*batch.schema.names, "ids", *more])

    return docs.mapInArrow(run, docs.withColumns({"ids": F.lit(None).cast("binary"), **{c: F.lit(None).cast(t) for c, t in more.items()}}).schema)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` (with a column text; null is empty and has no ids) and ``ids``: its pieces' ids as
    little-endian unsigned 32-bit integers. An older column of that name is replaced."""
    return _encoded(docs, model, {})


def decode(rows: DataFrame, model: str, column: str = "text") -> DataFrame:
    """``rows`` (with a column ids as ``encode`` gives it; null is empty) and, in ``column``, the text of the ids."""

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        rows = [np.frombuffer(i.as_buffer() or b"", "<u4") if i.is_valid else np.empty(0, np.uint32) for i in ids]
        return pa.array(surfaces_of(model).decode_many(np.concatenate([np.empty(0, np.uint32), *rows]), np.array([len(r) for r in rows], np.int64)), pa.string())

    settled(rows.sparkSession)
    return rows.withColumn(column, text("ids"))


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` with what ``encode`` gives (ids), what ``decode`` makes of it (decoded) and whether the model's own
    library gives the same ids (parity), all in one pass. Older columns of these names are replaced."""
    return _encoded(docs, model, {"decoded": "string", "parity": "boolean"})


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): the number and crc32 of the ids, parity with the
    model's own library, and whether decoding gives the text as it was (``decoded_same``; a normaliser that changes
    texts makes it false). A null text is empty and has no ids. A model that isn't rebuilt is an error.
    """
    rows = round_trip(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), model)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return rows.select("doc_id", n_tokens, F.crc32("ids").alias("ids_crc32"), "parity", (F.col("decoded") == F.col("text")).alias("decoded_same"))


def op10_sentencepiece_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
