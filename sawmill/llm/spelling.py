"""Operator 11: spelling variants, by blocked Gram matrices of letter counts.

Words are counted in two steps (distinct in a batch of texts, then by Spark). A word is then a
vector of letter counts. One inserted or deleted letter makes a squared distance of 1, a replaced
one of 2, so words are compared in blocks: a block holds the words with the same number of letters
in each of GROUPS groups of letters, and meets the blocks of the same length or one letter less
whose numbers differ as one edit allows. Between two tiles of blocks one NumPy product gives all
squared distances; pairs at 2 or less have their edit verified. Tiles have a bounded size, so a
large block is many tasks. A word's form is a join back; roots are found by pointer doubling.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, saved, scratch, steps, table
from .words import _LOWER

#: A word has so many code points and occurrences at least; a form has so many times the word's.
LETTERS, LEAST, TIMES = 6, 5, 5
#: One in so many runs loses a letter.
DROPS = 199
#: Groups of letters that name a block; words of a tile, and code points of its words at most (one word at least).
GROUPS, HOME, COMING, CHARS = 6, 1_024, 4_096, 100_000
#: Bytes of text in one vectorised step, and the longest run whose checksum is taken among others'.
STEP, LONG = 4_000_000, 48
#: Candidate pairs whose edits are verified at once.
PAIRS = 100_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the ends of its values; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data and len(data) else np.empty(0, np.uint8)), ends - ends[0]


def _continued(state: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The crc32 of what gave ``state`` followed by each run of ``data``: byte by byte for all runs at once, long ones alone."""
    state = ~state.astype(np.uint32)
    long = np.flatnonzero(size > LONG)
    order = np.argsort(-np.where(size > LONG, 0, size), kind="stable")
    longest_first, at, s = np.where(size > LONG, 0, size)[order], begin[order], state[order]
    for k in range(int(longest_first[0]) if len(order) else 0):
        n = int(np.searchsorted(-longest_first, -k, side="left"))
        s[:n] = _CRC[(s[:n] ^ data[at[:n] + k]) & 255] ^ (s[:n] >> np.uint32(8))
    state[order] = s
    out = ~state
    for i in long.tolist():
        out[i] = zlib.crc32(data[begin[i] : begin[i] + size[i]].tobytes(), int(out[i]))
    return out


def runs(batch: pa.RecordBatch) -> pa.StructArray:
    """The different words of a batch (doc_id, text) with their counts, before counts of other batches are added."""
    data, ends = _string_bytes(batch.column("text"))
    if not len(data):
        return pc.value_counts(pa.array([], pa.large_string()))
    data = _LOWER[data]
    lead = data == 0xC3
    letter = _LETTER[data] | lead
    letter[1:] |= lead[:-1]
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    first = ends[:-1][ends[:-1] < len(data)]
    start[first] |= letter[first]
    stop = letter.copy()
    stop[:-1] &= ~letter[1:]
    last = ends[1:][ends[1:] > 0] - 1
    stop[last] |= letter[last]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    length = end - begin - (leads[end] - leads[begin])
    keep = length >= LETTERS
    begin, end, length = begin[keep], end[keep], length[keep]
    ids = batch.column("doc_id").to_pylist()
    states = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    owner = np.searchsorted(ends, begin, side="right") - 1
    h = _continued(states[owner], data, begin, end - begin)
    drops = h % DROPS == 0
    cut = []
    for b, e, n, x in zip(begin[drops].tolist(), end[drops].tolist(), length[drops].tolist(), h[drops].tolist()):
        if n > LETTERS:
            word, at = data[b:e].tobytes().decode(), x % n
            cut.append(word[:at] + word[at + 1 :])
    begin, end = begin[~drops], end[~drops]
    size = end - begin
    offsets = np.concatenate([[0], np.cumsum(size)])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[begin] += 1
    inside[end] -= 1
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[np.cumsum(inside[:-1], dtype=np.int8) > 0])))
    return pc.value_counts(pa.concat_arrays([words, pa.array(cut, pa.large_string())]))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of all texts that occur LEAST times or more. Null texts have none; a null doc_id is empty in checksums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps([whole], chars=STEP):
                found = runs(batch)
                yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def _letter_groups(words: DataFrame) -> list[str]:
    """The letters in GROUPS groups of about equal use; at most as many rows as the alphabet has letters reach the driver."""
    use = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").collect()
    groups, load = [""] * GROUPS, [0] * GROUPS
    for r in use:
        g = load.index(min(load))
        groups[g], load[g] = groups[g] + r["c"], load[g] + r["n"]
    return groups


def _block(parts: list[Column]) -> Column:
    return F.concat_ws(",", *(p.cast("string") for p in parts))


def _in_letters(group: str) -> Column:
    return F.length("word") - F.length(F.translate("word", group, "")) if group else F.lit(0)


def _parts(n: Column, longest: Column, size: int) -> Column:
    """Into how many tiles so many words go."""
    return F.ceil(n / F.greatest(F.lit(1), F.least(F.lit(size), F.floor(F.lit(CHARS) / longest))))


def _tiles(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """The words of each block (with their n) in ``_parts`` lists of about equal size."""
    return rows.groupBy(*by, F.pmod(F.xxhash64("word"), "_parts").alias(f"{name}_tile")).agg(F.collect_list("word").alias(name), F.collect_list("n").alias(f"{name}_n"))


class _Tile:
    """The words of a tile: their letters as numbers (0 behind a word's end), lengths and letter counts."""

    def __init__(self, words: pa.Array):
        data, ends = _string_bytes(words)
        lead = data == 0xC3
        after = np.zeros(len(data), bool)
        after[1:] = lead[:-1]
        letters = np.where(after, data.astype(np.int16) - 0x80 + 27, data.astype(np.int16) - 96)[~lead]
        upto = np.concatenate([[0], np.cumsum(~lead)])[ends]
        self.size = np.diff(upto)
        self.owner = np.repeat(np.arange(len(self.size)), self.size)
        place = np.arange(len(letters)) - upto[:-1][self.owner]
        self.letters = np.zeros((len(self.size), int(self.size.max(initial=0)) + 1), np.uint8)
        self.letters[self.owner, place] = letters
        self.flat = letters

    def counts(self, number: np.ndarray, width: int) -> np.ndarray:
        at = self.owner * width + number[self.flat]
        return np.bincount(at, minlength=len(self.size) * width).reshape(-1, width).astype(np.float32)


def _one_edit(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether words of equal length differ in one place, or the longer one of b is the other with a letter more."""
    wide = max(a.shape[1], b.shape[1]) + 1
    a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))
    differ = a != b
    equal_length = size_a == size_b
    first = np.argmax(differ, axis=1)
    shifted = a[:, :-1] != b[:, 1:]
    late = np.arange(wide - 1)[None, :] >= first[:, None]
    return np.where(equal_length, differ.sum(1) == 1, differ.any(1) & ~(shifted & late).any(1))


def near_pairs(home: pa.Array, coming: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near words of two tiles: words of ``coming`` have as many letters as those of ``home`` or one more."""
    a, b = _Tile(home), _Tile(coming)
    used = np.zeros(128, bool)
    used[a.flat] = used[b.flat] = True
    number = np.cumsum(used) - 1
    width = int(used.sum())
    x, y = a.counts(number, width), b.counts(number, width)
    gram = x @ y.T
    gram *= -2
    gram += (x * x).sum(1)[:, None]
    gram += (y * y).sum(1)[None, :]
    i, j = np.nonzero(gram <= 2)
    kept = []
    for at in range(0, len(i), PAIRS):
        p, q = i[at : at + PAIRS], j[at : at + PAIRS]
        good = _one_edit(a.letters[p], a.size[p], b.letters[q], b.size[q])
        kept.append((p[good], q[good]))
    return (np.concatenate([p for p, _ in kept]), np.concatenate([q for _, q in kept])) if kept else (i[:0], j[:0])


def _meetings(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each block its number of tiles; and which blocks come to it (its own, and those that one edit may lead to), with theirs.

    The tables have a row a block and a row a meeting, whatever the number of words.
    """
    names = [f"_g{k}" for k in range(GROUPS)]
    own = [F.col(c) for c in names]
    less = lambda k, more=None: F.when(own[k] > 0, _block([c - 1 if i == k else c + 1 if i == more else c for i, c in enumerate(own)]))
    meets = F.array_compact(F.array(*(less(k) for k in range(GROUPS)), *(less(k, m) for k in range(GROUPS) for m in range(k + 1, GROUPS))))
    blocks = saved(placed.groupBy("own", *names).agg(F.count("*").alias("_n"), F.max(F.length("word")).alias("_l")))
    others = blocks.select("own", "_n", "_l", F.explode(meets).alias("block")).join(blocks.select(F.col("own").alias("block")), "block", "left_semi").withColumn("itself", F.lit(False))
    meetings = others.unionByName(blocks.select("own", "_n", "_l", F.col("own").alias("block"), F.lit(True).alias("itself")))
    sizes = meetings.groupBy("block", "itself").agg(_parts(F.sum("_n"), F.max("_l"), COMING).alias("_parts"))
    return blocks.select(F.col("own"), _parts(F.col("_n"), F.col("_l"), HOME).alias("_parts")), saved(meetings.join(sizes, ["block", "itself"]).select("own", "block", "itself", "_parts"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every near word of every word of ``words`` (word, n), both ways. No words give none."""
    groups = _letter_groups(words)
    counts = [_in_letters(g) for g in groups]
    placed = words.select("word", "n", _block(counts).alias("own"), *(c.alias(f"_g{k}") for k, c in enumerate(counts)))
    blocks, meetings = _meetings(placed)
    home = _tiles(placed.select("word", "n", "own").join(blocks, "own").withColumnRenamed("own", "block"), ["block"], "home")
    coming = _tiles(placed.select("word", "n", "own").join(meetings, "own"), ["block", "itself"], "coming")
    both = home.join(coming, "block").select("home", "home_n", "coming", "coming_n", "itself")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                a, a_n, b, b_n = (batch.column(c)[k].values for c in range(4))
                i, j = near_pairs(a, b)
                left, right = a.take(pa.array(i)), b.take(pa.array(j))
                if batch.column("itself")[k].as_py():  # every pair comes twice
                    once = pc.less(left, right)
                    i, j = i[once.to_numpy(zero_copy_only=False)], j[once.to_numpy(zero_copy_only=False)]
                    left, right = left.filter(once), right.filter(once)
                n, m = a_n.take(pa.array(i)), b_n.take(pa.array(j))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([left, right]), pa.concat_arrays([right, left]), pa.concat_arrays([m, n])], ["word", "near", "near_n"])

    return both.mapInArrow(run, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: each round doubles how far a word has followed. A form occurs
    TIMES as often as its word, so the rounds grow with the logarithm of the logarithm of the commonest word's count."""
    spark = forms.sparkSession
    path = scratch(spark)
    now, moved = saved(forms.select("word", F.col("form").alias("root")), path), True
    while moved:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = scratch(spark)
        then = saved(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), further)
        moved = bool(then.where("_moved").limit(1).count())
        remove(spark, path)
        now, path = then.select("word", "root"), further
    return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts have no words; repeated rows count again, with the same letters dropped; no rows give none. Of
    equally frequent near words the first in code-point order is the form.
    """
    words = saved(word_counts(docs))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("_less"), "near")).alias("_best"))
    near = near.select("word", "n_near", F.col("_best.near").alias("form"), (-F.col("_best._less")).alias("form_n"))
    judged = words.join(near, "word", "left").withColumn("_has", F.coalesce(F.col("form_n") >= TIMES * F.col("n"), F.lit(False)))
    rows = saved(judged.select("word", F.when(F.col("_has"), F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("_has"), F.col("form_n")).alias("form_n")))
    roots = _roots(rows.where("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
