"""Operator 13: phrase collocations by dynamic itemset counting.

Texts become rows of word hashes in SHARDS shards, which are read in turn, round and round. Lengths
are interleaved: words count from the first turn on; a longer phrase counts from the turn after both
its parts (without the last word, without the first) have reached LEAST so far, and until it has met
every shard once. So every count is of the whole corpus, and a short phrase needn't be finished
before longer ones begin. It ends when no phrase has reached LEAST for a whole cycle.

Maps of a fixed number of bits tell a task which phrases have reached LEAST, and while there are no
more than KNOWN of them, sorted hashes tell in which turn. With more, what maps let through wrongly is
dropped by joins; results are the same. Counts of unfinished phrases are a table of hashes and numbers
that each turn adds to in one shuffle; a last look at the shards finds the parts of the few that are
frequent. Words and phrases are named by 64-bit hashes with their language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remove, saved, scratch, steps, table
from .words import _LOWER, U, Words, mix

#: Occurrences that a phrase needs, and the longest phrases.
LEAST, LONGEST = 100, 5
#: Shards of a cycle, and bits of a map of phrases of one length.
SHARDS, BITS = 3, 1 << 22
#: Phrases that have reached LEAST of which tasks get the hashes (9 bytes each).
KNOWN = 2_000_000
#: Phrases of a language that are returned, and the factor of scores.
TOP, SCALE = 2_000, 1_000
#: Bytes of text, and words, in one vectorised step.
STEP, STEP_WORDS = 4_000_000, 1_000_000
NONE = "und"

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SPACE = _BREAK.copy()
_SPACE[[0x20, 0x09]] = True
_PLACE = np.random.default_rng(20240313).integers(1, 2**63, LONGEST, np.uint64) | U(1)
#: Stands between pieces of a text; no word's hash.
GAP = 0


class Pieces(Words):
    """The words of some texts and the piece that each is in."""

    def __init__(self, texts: list[str]):
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = _LOWER[np.frombuffer(b"\n".join([*raws, b""]), np.uint8)]
        space = _SPACE[self.data]
        change = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            change = np.concatenate([[0], change])
        self.begin, self.end = change[0::2], change[1::2]
        self.piece = np.cumsum(_BREAK[self.data])[self.begin] if len(self.begin) else np.empty(0, np.int64)
        ends = np.cumsum([len(r) + 1 for r in raws], dtype=np.int64)
        self.first = np.searchsorted(self.begin, np.concatenate([[0], ends]))

    def sequences(self) -> Iterator[np.ndarray]:
        """The hashes of each text's words, with GAP between pieces."""
        h = np.maximum(self.hashes(), U(1))
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            gaps = np.flatnonzero(self.piece[a + 1 : b] != self.piece[a : b - 1]) + 1 if b - a > 1 else np.empty(0, np.int64)
            yield np.insert(h[a:b], gaps, U(GAP))


def _read(docs: DataFrame, path: str) -> None:
    """Word hashes of each text by shard, and (in a folder of its own) the words that they name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "lang", "words", "hash", "word"]
        for whole in batches:
            for batch in steps([whole], chars=STEP):
                found = Pieces([t or "" for t in batch.column("text").to_pylist()])
                rows = [s.astype("<u8").tobytes() for s in found.sequences()]
                k = len(rows)
                yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("lang"), pa.array(rows, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string())], names)
                h, at = np.unique(np.maximum(found.hashes(), U(1)), return_index=True)
                k = len(h)
                words = [found.data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(found.begin[at].tolist(), found.end[at].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, -1, np.int32)), pa.nulls(k, pa.string()), pa.nulls(k, pa.binary()), pa.array(h.view(np.int64)), pa.array(words, pa.string())], names)

    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARDS)).cast("int")
    rows = docs.where("text is not null").select(shard.alias("shard"), F.coalesce("lang", F.lit(NONE)).alias("lang"), "text")
    rows.mapInArrow(run, "shard int, lang string, words binary, hash long, word string").write.partitionBy("shard").option("compression", "zstd").parquet(path)


class Reached:
    """The phrases of each length that have reached LEAST: maps of them all and of those of the last cycle, and their
    sorted hashes with the turns in which they did (None with more than KNOWN)."""

    def __init__(self, maps: np.ndarray | None = None):
        self.ever = np.zeros((LONGEST, BITS // 8), np.uint8)
        self.turns: list[np.ndarray] = []
        self.known: list[tuple[np.ndarray, np.ndarray]] | None = [(np.empty(0, U), np.empty(0, np.int8))] * LONGEST

    def add(self, new: DataFrame, turn: int) -> None:
        """The phrases (length, h) of a turn. Only so many hashes as KNOWN allows reach the driver, or bits."""
        bits = np.zeros_like(self.ever)
        cell = F.col("h").bitwiseAND(F.lit(BITS - 1).cast("long"))
        if self.known is not None and sum(len(h) for h, _ in self.known) + new.count() <= KNOWN:
            got = new.toArrow()
            level, h = got["length"].to_numpy(), got["h"].to_numpy().view(np.uint64)
            for k, (old, when) in enumerate(self.known):
                mine = h[level == k + 1]
                both, at = np.concatenate([old, mine]), np.concatenate([when, np.full(len(mine), turn, np.int8)])
                order = np.argsort(both)
                self.known[k] = (both[order], at[order])
        else:
            self.known = None
            got = new.select("length", cell.alias("h")).distinct().toArrow()  # BITS a length at most
            level, h = got["length"].to_numpy(), got["h"].to_numpy().view(np.uint64)
        for k, row in enumerate(bits):
            c = (h[level == k + 1] & U(BITS - 1)).astype(np.int64)
            np.bitwise_or.at(row, c >> 3, np.left_shift(1, c & 7).astype(np.uint8))
        self.ever |= bits
        self.turns = [*self.turns, bits][-SHARDS:]

    def recent(self) -> bool:
        """Whether a phrase that longer ones may hold has reached LEAST in the last cycle."""
        return any(t[:-1].any() for t in self.turns)

    def told(self) -> tuple:
        """What tasks get: maps without their zeros, and hashes."""
        lately = reduce(np.bitwise_or, self.turns, np.zeros_like(self.ever))
        return [[(np.flatnonzero(m).astype(np.int32), m[m != 0]) for m in maps] for maps in (self.ever, lately)], self.known, BITS // 8


class Lookup:
    """The same in a task."""

    def __init__(self, told: tuple):
        maps, self.known, size = told
        self.ever, self.lately = (np.zeros((LONGEST, size), np.uint8) for _ in maps)
        for full, levels in zip((self.ever, self.lately), maps):
            for level, (at, bits) in zip(full, levels):
                level[at] = bits

    def place(self, length: int, h: np.ndarray) -> np.ndarray:
        """Where each phrase of ``known`` stands; -1 for others."""
        known = self.known[length - 1][0]
        at = np.searchsorted(known, h)
        at[at == len(known)] = 0
        return np.where(known[at] == h, at, -1) if len(known) else np.full(len(h), -1)

    def reached(self, length: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` of the phrases that have reached LEAST, and the turns in which they did (by maps alone, unknown: -1)."""
        at = np.flatnonzero(_bit(self.ever[length - 1], h))
        if self.known is None:
            return at, np.full(len(at), -1, np.int8)
        place = self.place(length, h[at])
        return at[place >= 0], self.known[length - 1][1][place[place >= 0]]


def _bit(level: np.ndarray, h: np.ndarray) -> np.ndarray:
    c = (h & U(8 * len(level) - 1)).astype(np.int64)
    return (level[c >> 3] >> (c & 7).astype(np.uint8)) & 1 > 0


def phrases(words: np.ndarray, lang: U, look: Lookup) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, phrases, the hashes of their parts, the later turn in which a part reached LEAST) in one sequence with GAPs: all
    words, then whatever has two parts that have reached LEAST. A word has its language and its own hash instead of parts."""
    at = np.flatnonzero(words != GAP)
    h = mix(words[at] * _PLACE[0] + lang + U(1))
    yield 1, h, np.full(len(h), lang), words[at], np.full(len(h), -1, np.int8)
    for length in range(2, LONGEST + 1):
        good, turn = look.reached(length - 1, h)
        at, h = at[good], h[good]
        follows = np.flatnonzero(at[1:] == at[:-1] + 1)
        at, first, last, turn = at[follows], h[follows], h[follows + 1], np.maximum(turn[follows], turn[follows + 1])
        if not len(at):
            return
        h = np.full(len(at), U(length) + lang)
        for k in range(length):
            h += words[at + k] * _PLACE[k]
        h = mix(h)
        yield length, h, first, last, turn


def _sequences(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[U, np.ndarray]]:
    """The words of some texts of a language at a time, about ``step`` of them."""
    have: dict[int, list[bytes]] = {}
    held = 0
    join = lambda: [(U(g & (2**64 - 1)), np.frombuffer(GAP.to_bytes(8, "little").join(rows), "<u8")) for g, rows in have.items()]
    for batch in batches:
        for g, row in zip(batch.column("g").to_pylist(), batch.column("words").to_pylist()):
            have.setdefault(g, []).append(row)
            held += len(row)
            if held > 8 * step:
                yield from join()
                have, held = {}, 0
    yield from join()


def _by_language(rows: DataFrame) -> DataFrame:
    return rows.select(F.xxhash64("lang").alias("g"), "words")


COUNTS = "length tinyint, h long, begun tinyint, n long"
#: What has reached LEAST, and in which turn.
KEPT = "length tinyint, h long, turn tinyint"


def _count(shard: DataFrame, reached: Reached, turn: int) -> DataFrame:
    """COUNTS of what is to be counted in a shard, of some texts at a time; length 0 has a language's words. Where only maps tell
    what has reached LEAST, also the hashes of the parts."""
    told, step, shards, parts = reached.told(), STEP_WORDS, SHARDS, reached.known is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(told)
        for lang, words in _sequences(batches, step):
            for length, h, first, last, when in phrases(words, lang, look):
                if length == 1 and turn >= shards:
                    continue
                if length == 1 and len(h):
                    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int8()), pa.array(np.array([lang]).view(np.int64)), pa.array([0], pa.int8()), pa.array([len(h)], pa.int64()), *[pa.nulls(1, pa.int64())] * (2 * parts)], names)
                if length > 1:  # what one of the last cycle is part of
                    due = (_bit(look.lately[length - 2], first) | _bit(look.lately[length - 2], last)) if parts else when >= turn - shards
                    h, first, last, when = h[due], first[due], last[due], when[due]
                v, i, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), length, np.int8)), pa.array(v.view(np.int64)), pa.array(when[i] + np.int8(1)), pa.array(n.astype(np.int64)), *[pa.array(x[i].view(np.int64)) for x in (first, last)[: 2 * parts]]], names)

    names = ["length", "h", "begun", "n", *["first", "last"][: 2 * parts]]
    return _by_language(shard).mapInArrow(run, COUNTS + (", first long, last long" if parts else ""))


def _begun(found: DataFrame, known: DataFrame, turn: int) -> DataFrame:
    """Of the longer phrases those whose parts have really reached LEAST, with the turn from which they count."""
    found = found.groupBy("length", "h").agg(F.max("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    part = lambda name: known.select((F.col("length") + 1).cast("tinyint").alias("length"), F.col("h").alias(name), F.col("turn").alias(f"_{name}"))
    longer = found.where("length > 1").join(part("first"), ["length", "first"]).join(part("last"), ["length", "last"])
    longer = longer.withColumn("begun", (F.greatest("_first", "_last") + 1).cast("tinyint")).where(F.col("begun") > turn - SHARDS)
    return found.where("length < 2").withColumn("begun", F.lit(0).cast("tinyint")).unionByName(longer.select(found.columns + ["begun"])).select("length", "h", "begun", "n")


def _named(rows: DataFrame, finals: DataFrame, reached: Reached) -> DataFrame:
    """(length, h, first, last, n) of ``finals``: one look at all shards for their parts, each once a task while their hashes are known."""
    told, step = reached.told(), STEP_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(told)
        seen = [np.zeros(len(h), bool) for h, _ in look.known] if look.known is not None else None
        for lang, words in _sequences(batches, step):
            for length, h, first, last, _ in phrases(words, lang, look):
                at, _ = look.reached(length, h)
                h, i = np.unique(h[at], return_index=True)
                if seen is not None:
                    place = look.place(length, h)
                    new = ~seen[length - 1][place]
                    seen[length - 1][place] = True
                    h, i = h[new], i[new]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), length, np.int8)), *(pa.array(x.view(np.int64)) for x in (h, first[at][i], last[at][i]))], ["length", "h", "first", "last"])

    # A phrase is told once a task, so there are no more tasks than the cluster can run, however many files there are.
    few = _by_language(rows).coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
    parts = few.mapInArrow(run, "length tinyint, h long, first long, last long").groupBy("length", "h").agg(F.max("first").alias("first"), F.max("last").alias("last"))
    return finals.join(parts, ["length", "h"], "left")


def counted(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(length, h, first, last, n) of every phrase of up to LONGEST words that occurs LEAST times; (hash, word) of all words; (g, lang).

    ``first`` and ``last`` are the hashes of a phrase's parts, or g and hash of a word. Under length 0 are the words of each language.
    """
    spark, path = docs.sparkSession, scratch(docs.sparkSession)
    _read(docs, path)
    rows = spark.read.schema("lang string, words binary, hash long, word string, shard int").parquet(path)
    reached, turn, state, old = Reached(), 0, None, None
    news: list[str] = []
    ended: list[str] = []
    while turn < SHARDS or reached.recent():
        found = _count(rows.where(F.col("shard") == turn % SHARDS), reached, turn)
        if reached.known is None:
            found = _begun(found, spark.read.schema(KEPT).parquet(*news), turn)
        found = found.select("length", "h", "begun", "n", F.lit(0).cast("long").alias("before"))
        if state is not None:
            found = found.unionByName(state.select("length", "h", "begun", "n", F.col("n").alias("before")))
        found = found.groupBy("length", "h").agg(F.max("begun").alias("begun"), F.sum("n").alias("n"), F.sum("before").alias("before"))
        # What can't change any more and hasn't reached LEAST isn't written.
        over, often = F.col("begun") + SHARDS - 1 <= turn, (F.col("n") >= LEAST) | (F.col("length") == 0)
        here, new, end = scratch(spark), scratch(spark), scratch(spark)
        fresh = (F.col("n") >= LEAST) & (F.col("before") < LEAST) & (F.col("length") > 0)
        now = saved(found.where(~over | often).select("length", "h", "begun", "n", fresh.alias("fresh"), over.alias("over")), here)
        reached.add(saved(now.where("fresh").select("length", "h", F.lit(turn).cast("tinyint").alias("turn")), new), turn)
        news.append(new)
        saved(now.where(F.col("over") & often).select("length", "h", "n"), end)
        ended.append(end)
        state = now.where("not over").select("length", "h", "begun", "n")
        if old:
            remove(spark, old)
        old, turn = here, turn + 1
    finals = spark.read.schema("length tinyint, h long, n long").parquet(*ended)
    found = saved(_named(rows.where(F.col("shard") >= 0), finals, reached))
    remove(spark, old, *news, *ended)
    return found, rows.where(F.col("shard") == -1).select("hash", "word"), rows.where(F.col("shard") >= 0).select("lang").distinct().withColumn("g", F.xxhash64("lang"))


def _scores() -> Column:
    """The cut of the lowest score and, of several, the fewest words before it, from counts of all beginnings and endings."""
    big = lambda x: f"cast({x} as decimal(19, 0))"
    left, right = "begins[k - 1]", "ends[length - k - 1]"
    cut = f"named_struct('score', ({SCALE} * ({big('a')} * {big('n')})) div ({big(left)} * {big(right)}), 'k', k, 'l', {left}, 'r', {right})"
    return F.expr(f"array_min(transform(sequence(1, int(length) - 1), k -> {cut}))")


def _candidates(found: DataFrame, words: DataFrame, langs: DataFrame) -> DataFrame:
    """(length, h, g, phrase, a, begins, ends) of phrases of two words and more: a join of both parts for each length."""
    ones = found.where("length = 1").select("h", F.col("first").alias("g"), F.col("last").alias("hash"), "n")
    named = words.join(ones.select("hash").distinct(), "hash", "left_semi").dropDuplicates(["hash"])
    now = saved(ones.join(named, "hash").select("h", "g", F.col("word").alias("phrase"), F.col("word").alias("tail"), F.array("n").alias("begins"), F.array("n").alias("ends")))
    every = []
    for length in range(2, LONGEST + 1):
        first = now.select(F.col("h").alias("first"), "g", "phrase", "begins")
        last = now.select(F.col("h").alias("last"), "tail", "ends")
        rows = found.where(F.col("length") == length).join(first, "first").join(last, "last")
        own = F.array("n")
        now = saved(rows.select("length", "h", "first", "last", "g", F.concat_ws(" ", "phrase", "tail").alias("phrase"), "tail", F.col("n").alias("a"), F.concat("begins", own).alias("begins"), F.concat("ends", own).alias("ends")))
        every.append(now.drop("tail"))
    return reduce(lambda a, b: a.unionByName(b), every)


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the TOP best phrases of each language of ``docs`` (doc_id, text, lang; other columns are ignored).

    A null text has no words and a null lang is ``und``; repeated rows count again; no rows give none. A phrase that occurs
    as often as a longer one around it is left out: what is longer by several words then has one of one word more as often.
    """
    found, words, langs = counted(docs)
    every = _candidates(found, words, langs)
    total = found.where("length = 0").select(F.col("h").alias("g"), "n").join(langs, "g")
    around = every.where("length > 2").select((F.col("length") - 1).cast("tinyint").alias("length"), F.explode(F.array("first", "last")).alias("h"), "a")
    left = every.join(around, ["length", "h", "a"], "left_anti").join(total, "g").withColumn("best", _scores())
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase"))
    ranked = left.withColumn("rank", place).where(F.col("rank") <= TOP)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


def op13_dynamic_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
