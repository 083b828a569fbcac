"""Operator 1: document fingerprints as invertible Bloom lookup sketches.

A text is a set of paragraph digests: lines, where a line is cut further at word
ends that its own content chooses (one in ``CUT`` words, or ``LONGEST`` words on), so that an edit changes
the digests around it only. A repeated paragraph counts with its occurrence number.
Each digest goes into one cell in each of three rows; a cell holds a count, the xor
of the digests and the xor of their checks. Two versions' sketches subtract cell by
cell, and peeling cells that hold one digest recovers the digests on which the
versions differ. Where peeling gets stuck both sides build a larger sketch; a
sketch of more cells folds into one of fewer.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_CHARS, in_id_order, partitions, saved, settled, steps, table, texts_of

ROWS = 3
#: log2 of the cells in a row of a stored fingerprint, and of the step after a failed peeling.
SIZE, LARGER = 3, 2
#: One word end in so many ends a paragraph inside a line; one of more words is cut, and so is
#: each of a text's first words, which makes short texts comparable.
CUT, LONGEST, BEGINNING = 4, 8, 8
COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long, edited_differs_by long, next_differs_by long"
COMPARED = "doc_id long, likeness double, added array<long>, removed array<long>"

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All paragraph digests of the texts one after another, and each text's number of them."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join([*raws, b""])
    if not data:
        return np.empty(0, _U), np.zeros(len(texts), np.int64)
    b = np.frombuffer(data, np.uint8)
    white = b <= 0x20
    end = np.flatnonzero(white & np.concatenate([[False], ~white[:-1]]))  # after each word
    text_end = np.cumsum([len(r) + 1 for r in raws])
    text_begin, of = np.concatenate([[0], text_end[:-1]]), np.searchsorted(text_end, end, side="right")
    before = end - text_begin[of]  # bytes of the text up to here; what stands before it plays no part
    w = b.astype(np.uint32)
    tail = w[end - 1] * 31 + np.where(before > 1, w[np.maximum(end - 2, 0)], 0) * 17 + np.where(before > 2, w[np.maximum(end - 3, 0)], 0) * 7
    chosen = (b[end] == 0x0A) | (((tail * np.uint32(2654435761)) >> np.uint32(24)) % CUT == 0)
    word = np.arange(len(end))
    first = np.searchsorted(end, text_begin)[of]
    since = word - np.maximum(np.maximum.accumulate(np.where(chosen, word, -1)), first - 1)
    end = end[chosen | (word - first < BEGINNING) | (since % LONGEST == 0)]
    end = np.union1d(end, np.flatnonzero(b == 0x0A))
    begin = np.concatenate([[0], end[:-1] + 1])
    view = memoryview(data)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(s) if (s := bytes(view[x:y]).strip()) else 0 for x, y in zip(begin.tolist(), end.tolist())), _U, len(end))
    owner = np.searchsorted(text_end, end, side="right")
    hashed, owner = hashed[hashed != 0], owner[hashed != 0]
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    copy = np.maximum.accumulate(np.where(new, np.arange(len(hashed)), 0))
    return _mix(hashed + (np.arange(len(hashed)) - copy).astype(_U) * _U(0x9E3779B97F4A7C15)), np.bincount(owner, minlength=len(texts)).astype(np.int64)


class Sketches:
    """Sketches of many sets with 2**size cells in each of three rows."""

    def __init__(self, n: int, size: int):
        self.n, self.size = n, size
        cells = n * ROWS << size
        self.count, self.keys, self.checks = np.zeros(cells, np.int32), np.zeros(cells, _U), np.zeros(cells, np.uint32)

    def add(self, owner: np.ndarray, digest: np.ndarray, sign: int | np.ndarray = 1) -> None:
        check = _mix(digest ^ _U(0x5BD1E995)).astype(np.uint32)
        for row in range(ROWS):
            at = ((owner * ROWS + row) << self.size) + (_mix(digest + _U(row + 1)) & _U((1 << self.size) - 1)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, digest)
            np.bitwise_xor.at(self.checks, at, check)

    def fold(self) -> Sketches:
        """The sketches of half as many cells: a digest's cell is its hash's low bits."""
        out, shape = Sketches(0, self.size - 1), (self.n, ROWS, 2, 1 << self.size - 1)
        out.n = self.n
        out.count = self.count.reshape(shape).sum(2, dtype=np.int32).ravel()
        out.keys = np.bitwise_xor.reduce(self.keys.reshape(shape), 2).ravel()
        out.checks = np.bitwise_xor.reduce(self.checks.reshape(shape), 2).ravel()
        return out

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(0, self.size)
        out.n = self.n
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, digest, sign) of what the sketches hold, and which owners came out whole. Uses the sketches up."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            at = np.flatnonzero(np.abs(self.count) == 1)
            at = at[_mix(self.keys[at] ^ _U(0x5BD1E995)).astype(np.uint32) == self.checks[at]]
            if not len(at):
                break
            owner, digest, sign = at // (ROWS << self.size), self.keys[at], self.count[at]
            order = np.lexsort((digest, owner))
            owner, digest, sign = owner[order], digest[order], sign[order]
            new = np.ones(len(order), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])
            found.append((owner[new], digest[new], sign[new]))
            self.add(owner[new], digest[new], -sign[new])
        left = ((self.count != 0) | (self.keys != 0) | (self.checks != 0)).reshape(self.n, -1).any(1)
        empty = (np.empty(0, np.int64), np.empty(0, _U), np.empty(0, np.int32))
        return *(np.concatenate(x) for x in zip(empty, *found)), ~left

    def texts(self, n: np.ndarray) -> list[str]:
        """Each sketch with its number of paragraphs as a string."""
        c, k, s = (x.reshape(self.n, -1) for x in (self.count.astype("<i4"), self.keys.astype("<u8"), self.checks.astype("<u4")))
        return [base64.b64encode(np.array([m], "<u4").tobytes() + a.tobytes() + b.tobytes() + d.tobytes()).decode() for m, a, b, d in zip(n.tolist(), c, k, s)]

    @classmethod
    def read(cls, prints: list[str | None], size: int) -> tuple[Sketches, np.ndarray]:
        """Sketches of 2**size cells a row from the strings of ``texts`` of as many cells or more, and the numbers of paragraphs.
        No string is an empty text."""
        out, n, of_size = cls(len(prints), size), np.zeros(len(prints), np.int64), {}
        for i, p in enumerate(prints):
            if p is not None:
                of_size.setdefault(size_of(p), []).append(i)
        for own, at in of_size.items():
            cells, some = ROWS << own, cls(len(at), own)
            raw = np.frombuffer(b"".join(base64.b64decode(prints[i]) for i in at), np.uint8).reshape(len(at), 4 + 16 * cells)
            n[at], some.count = raw[:, :4].copy().view("<u4").ravel(), raw[:, 4 : 4 + 4 * cells].copy().view("<i4").ravel()
            some.keys, some.checks = raw[:, 4 + 4 * cells : 4 + 12 * cells].copy().view("<u8").ravel(), raw[:, 4 + 12 * cells :].copy().view("<u4").ravel()
            while some.size > size:
                some = some.fold()
            for mine, theirs in ((out.count, some.count), (out.keys, some.keys), (out.checks, some.checks)):
                mine.reshape(out.n, -1)[at] = theirs.reshape(len(at), -1)
        return out, n


def size_of(fingerprint: str) -> int:
    """log2 of the cells in a row of a fingerprint."""
    cells, rest = divmod(len(fingerprint) // 4 * 3 - fingerprint[-2:].count("=") - 4, 16 * ROWS)
    if rest or cells < 1 or cells & (cells - 1):
        raise ValueError("not a fingerprint")
    return cells.bit_length() - 1


def _of(digest: np.ndarray, n: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of chosen texts, with the place of each text among those chosen."""
    begin, n = (np.cumsum(n) - n)[rows], n[rows]
    return np.repeat(np.arange(len(rows)), n), digest[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def differences(digest: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, size: int = SIZE, recovered: list | None = None) -> np.ndarray:
    """How many digests each pair of texts (by place) differs by, as its subtracted sketches peel.

    A pair whose sketches don't peel is built again, larger, until it does. ``recovered`` gets what
    was peeled: arrays of pairs, of digests, and of signs (1: left only, -1: right only).
    """
    out, todo = np.zeros(len(left), np.int64), np.arange(len(left))
    while len(todo):
        stuck = []
        block = max(1, 2_000_000 // (ROWS << size))
        for some in (todo[i : i + block] for i in range(0, len(todo), block)):
            a, b = Sketches(len(some), size), Sketches(len(some), size)
            a.add(*_of(digest, n, left[some]))
            b.add(*_of(digest, n, right[some]))
            owner, found, sign, whole = a.minus(b).peel()
            out[some] = np.bincount(owner, minlength=len(some))
            stuck.append(some[~whole])
            if recovered is not None:
                recovered.append((some[owner[whole[owner]]], found[whole[owner]], sign[whole[owner]]))
        todo, size = np.concatenate(stuck), size + LARGER
    return out


def likeness(differ: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Shared paragraphs against all, counted on both sides: 1 for equal texts, 0 for nothing in common."""
    return np.where(n + m == 0, 1.0, 1 - differ / np.maximum(n + m, 1))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
    """Rows of all texts but the last, which only follows."""
    k = len(ids)
    versions = [edited(a, b) for a, b in zip(texts, texts[1:])]
    digest, n = digests(texts + versions)
    place = np.arange(k)
    to_edited, to_next = (differences(digest, n, place, at) for at in (place + k + 1, place + 1))
    sketches = Sketches(len(n), SIZE)
    sketches.add(np.repeat(np.arange(len(n)), n), digest)
    prints = sketches.texts(n)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:k]], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in versions], pa.string()),
            pa.array(prints[:k], pa.string()), pa.array(prints[k + 1 :], pa.string()),
            pa.array(likeness(to_edited, n[:k], n[k + 1 :])), pa.array(likeness(to_next, n[:k], n[1 : k + 1])),
            pa.array(n[:k]), pa.array(to_edited), pa.array(to_next),
        ],
        [c.split()[0] for c in COLUMNS.split(", ")],
    )


def fingerprint(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_paragraphs and fingerprint of every row of ``docs`` (doc_id, text; others are ignored). Null is empty.

    With 2**size cells in each of three rows, versions that differ by about twice as many paragraphs can be told apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, chars=STEP_CHARS // 4):
            digest, n = digests(texts_of(batch))
            sketches = Sketches(len(n), size)
            sketches.add(np.repeat(np.arange(len(n)), n), digest)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(sketches.texts(n), pa.string())], ["doc_id", "n_paragraphs", "fingerprint"])

    settled(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_paragraphs long, fingerprint string")


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """What differs between two versions of a table (doc_id, text; others are ignored), by doc_id: ``likeness``, and the
    recovered digests of paragraphs that only the new version has (``added``) or only the old one (``removed``).

    Documents of one version only are compared with an empty text; rows without doc_id are left out.
    Where doc_ids repeat, every old row of one is compared with every new row of it.
    """
    both = old.select(F.col("doc_id").cast("long"), F.col("text").alias("text")).join(new.select(F.col("doc_id").cast("long"), F.col("text").alias("later")), "doc_id", "full_outer").where("doc_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wide in steps(batches, chars=STEP_CHARS // 4):
            for batch in steps([wide], "later", STEP_CHARS // 4):
                k, peeled = len(batch), []
                digest, n = digests(texts_of(batch) + texts_of(batch, "later"))
                differ = differences(digest, n, np.arange(k), np.arange(k) + k, recovered=peeled)
                owner, found, sign = (np.concatenate([x[i] for x in peeled]) for i in range(3))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(likeness(differ, n[:k], n[k:])), *_sides(k, owner, found, sign)], ["doc_id", "likeness", "added", "removed"])

    settled(old.sparkSession)
    return both.mapInArrow(run, COMPARED)


def _sides(k: int, owner: np.ndarray, found: np.ndarray, sign: np.ndarray) -> list[pa.ListArray]:
    """What only the second has and what only the first has, as a list for each of k pairs."""
    sides = []
    for s in (-1, 1):
        at, some = owner[sign == s], found[sign == s].astype(np.int64)
        some = some[np.lexsort((some, at))]
        sides.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=k))]).astype(np.int32)), pa.array(some)))
    return sides


def compare_stored(old: DataFrame, new: DataFrame, texts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """What ``compare`` gives, from two tables that ``fingerprint`` wrote (of sizes that may differ), without the texts.

    A pair whose subtracted sketches don't peel has nulls. With ``texts``, the two tables of texts, those documents alone
    are looked up there and their sketches are built larger. Documents of one table only are compared with an empty
    text; rows without doc_id are left out; where doc_ids repeat, every old row of one meets every new one.
    """
    both = old.select(F.col("doc_id").cast("long"), "fingerprint").join(new.select(F.col("doc_id").cast("long"), F.col("fingerprint").alias("later")), "doc_id", "full_outer").where("doc_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wide in steps(batches, "fingerprint", STEP_CHARS // 4):
            for batch in steps([wide], "later", STEP_CHARS // 4):
                left, right = (batch.column(c).to_pylist() for c in ("fingerprint", "later"))
                sizes = np.array([min((size_of(x) for x in pair if x is not None), default=SIZE) for pair in zip(left, right)])
                for size in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == size)
                    (a, n), (b, m) = (Sketches.read([side[i] for i in at], size) for side in (left, right))
                    owner, found, sign, whole = a.minus(b).peel()
                    like = likeness(np.bincount(owner, minlength=len(at)), n, m)
                    sides = [pa.ListArray.from_arrays(x.offsets, x.values, mask=pa.array(~whole)) for x in _sides(len(at), owner, found, sign)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(like, mask=~whole), *sides], ["doc_id", "likeness", "added", "removed"])

    settled(old.sparkSession)
    found = both.mapInArrow(run, COMPARED)
    if texts is None:
        return found
    found = saved(found)
    stuck = found.where("likeness is null").select("doc_id").distinct()
    # All pairs of such a document are compared again, so those of its pairs that did peel aren't kept as well.
    later = compare(*(t.select("doc_id", "text").join(stuck, "doc_id", "left_semi") for t in texts))
    return found.join(stuck, "doc_id", "left_anti").unionByName(later)


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """Fingerprints every text (null: empty) of ``docs`` (doc_id, text; other columns are ignored)
    and its edited text, whose second half is the next document's beginning; ``near_*`` are
    likenesses of fingerprints, ``*_differs_by`` the recovered differences.

    Next is by doc_id; null doc_ids come first (many of them by hashes of their texts) and rows of one doc_id are in order of text. The
    row after the last is the first one, so a single row follows itself. No rows give none.
    One shuffle by ranges of doc_id; a part's last text finds the next part's first, which is sent to both.
    """
    spark = settled(docs.sparkSession)
    rows, _ = in_id_order(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), 4 * partitions(spark))
    firsts = [(r["part"], r["nulls"], r["first"]) for r in rows.groupBy("part").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("nulls")).orderBy("part").collect()]  # one row a part, a fixed number
    before = spark.createDataFrame([(p, None if nulls else first, firsts[i - 1][0]) for i, (p, nulls, first) in enumerate(firsts)], "part int, first_id long, to int")
    heads = rows.join(F.broadcast(before), "part").where(F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("part", F.col("to")).agg(F.min(F.struct("doc_id", "text")).alias("head"))  # of rows of one doc_id or none
    heads = heads.select("head.doc_id", "head.text", F.col("to").alias("part"), F.lit(True).alias("follows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, texts, size = None, [], [], 0
        for batch in steps(batches):
            for p, i, t, follows in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text", "follows"))):
                if follows:
                    if p == part and len(ids) == len(texts):
                        yield _rows(ids, [*texts, t])
                        part, ids, texts, size = None, [], [], 0
                    continue
                if p == part and size > STEP_CHARS // 4:
                    yield _rows(ids, [*texts, t])
                    ids, texts, size = [], [], 0
                part = p
                ids.append(i)
                texts.append(t)
                size += len(t)

    both = rows.select("doc_id", "text", "part", F.lit(False).alias("follows")).unionByName(heads)
    return both.repartition(partitions(spark), "part").sortWithinPartitions("part", "follows", "doc_id", "text").mapInArrow(run, COLUMNS)


def op1_invertible_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_versions(table(spark, sf_dir, "documents"))
