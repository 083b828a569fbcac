"""Operator 12: language by sparse multinomial logistic regression on TF-IDF character n-grams.

A text's letters (lower case, all else one blank) give n-grams of one to three characters, hashed
to CELLS places. How many texts have a place is counted over all learning rows; weights are learned
by follow-the-regularised-leader with elastic-net penalties, in EPOCHS passes: each pass goes over
SHARDS parts of a sample at once, and the parts' states are averaged. What the penalty leaves at
zero stays zero. Last, one temperature is fitted on rows of the sample that no pass has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, steps, table, texts_of
from .words import U, mix

#: Places that n-grams are hashed to, and their longest length.
CELLS, LONGEST = 1 << 14, 3
#: Rows of a language that weights are learned from, about: the documented bound of the sample. One in CALIBRATES of them only calibrates.
SAMPLE, CALIBRATES = 6_000, 5
#: Parts of the sample and passes over them; the same at every size of cluster.
SHARDS, EPOCHS = 6, 4
#: Learning rate and its damping, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1e-4
#: Code points of text in one vectorised step.
STEP = 1_500_000
UNKNOWN = "und"

_SALT = np.random.default_rng(20240212).integers(1, 2**63, LONGEST, np.uint64) | U(1)


@cache
def _letters() -> np.ndarray:
    """For every code point its lower case if it is a letter, else a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places and their counts of each text; none for a text without letters."""
    chars = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    low = _letters()[chars]
    blank = low == 32
    keep = ~blank
    keep[:1] = True
    keep[1:] |= ~blank[:-1]  # one blank of each run
    keep[ends[:-1]] = True
    low, upto = low[keep].astype(np.uint64), np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
    places = []
    for n in range(1, LONGEST + 1):
        h = np.full(max(len(low) - n + 1, 0), U(n))
        for k in range(n):
            h += low[k : k + len(h)] * _SALT[k]
        places.append((mix(h) >> U(64 - CELLS.bit_length() + 1)).astype(np.uint16))
    real = low != 32
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
        if not real[a:b].any():
            yield np.empty(0, np.int64), np.empty(0, np.int64)
            continue
        mine = np.concatenate([places[0][a:b][real[a:b]], *(p[a : max(b - n, a)] for n, p in enumerate(places[1:], 1))])
        if len(mine) < CELLS // 16:
            yield np.unique(mine.astype(np.int64), return_counts=True)
        else:
            count = np.bincount(mine, minlength=CELLS)
            at = np.flatnonzero(count)
            yield at, count[at]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        yield from steps([whole], chars=STEP)


def tf_idf(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Values of a text's places: damped counts by inverse document frequency, of length 1."""
    x = (1 + np.log(count)) * idf[at]
    return x / np.sqrt((x * x).sum()) if len(x) else x


class Leader:
    """Follow the regularised leader, one weight a language and place: what it remembers and the weights that follow from it."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, language: int) -> None:
        w = self.weights(at)
        p = softmax(w @ x)
        p[language] -= 1
        g = p[:, None] * x[None, :]
        n = self.n[:, at]
        more = n + g * g
        self.z[:, at] += g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[:, at] = more


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass(frozen=True)
class Model:
    """Languages, inverse document frequencies, weights (mostly zero) and temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> Iterator[np.ndarray | None]:
        for at, count in grams(texts):
            yield self.weights[:, at] @ tf_idf(at, count, self.idf) if len(at) else None

    def of(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for logits in self.logits(texts):
            p = softmax(logits / self.temperature) if logits is not None and self.languages else None
            names.append(UNKNOWN if p is None else self.languages[int(p.argmax())])
            scores.append(0.0 if p is None else float(p.max()))
        return names, scores


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _frequencies(learning: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each place occurs, and how many texts there are with letters: one vector a task, added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(CELLS + 1, np.int64), 0
        for batch in _pieces(batches):
            for at, _ in grams(texts_of(batch)):
                total[at] += 1
                texts += len(at) > 0
        total[CELLS] = texts
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    found = learning.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # CELLS + 1 rows at most
    total = np.zeros(CELLS + 1, np.int64)
    total[found["at"].to_numpy()] = found["n"].to_numpy()
    return total[:CELLS], int(total[CELLS])


def _vectors(sample: DataFrame, idf: np.ndarray, languages: list[str]) -> DataFrame:
    """(shard, turn, language, at, x) of the sample's rows with letters; the last shard calibrates."""
    number = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            rows = [(s, t, number[name], at, tf_idf(at, count, idf)) for s, t, name, (at, count) in zip(batch.column("shard").to_pylist(), batch.column("turn").to_pylist(), batch.column("lang").to_pylist(), grams(texts_of(batch))) if len(at)]
            if rows:
                shard, turn, language, at, x = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(turn, pa.int64()), pa.array(language, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))], ["shard", "turn", "language", "at", "x"])

    return saved(sample.mapInArrow(run, "shard int, turn long, language int, at array<int>, x array<float>"))


def _row(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    return batch.column("at")[k].values.to_numpy(), batch.column("x")[k].values.to_numpy().astype(float), batch.column("language")[k].as_py()


def _learned(vectors: DataFrame, k: int) -> np.ndarray:
    """Weights after EPOCHS passes. A shard's rows are bounded by the sample, and only states, of a fixed size, reach the driver."""
    z, n = np.zeros((k, CELLS)), np.zeros((k, CELLS))
    parts = vectors.where(F.col("shard") < SHARDS).repartition(SHARDS, "shard").sortWithinPartitions("shard", "turn")
    for _ in range(EPOCHS):

        def run(batches: Iterator[pa.RecordBatch], z=z.astype(np.float32), n=n.astype(np.float32)) -> Iterator[pa.RecordBatch]:
            shards: dict[int, tuple[Leader, int]] = {}
            for batch in batches:
                for i, shard in enumerate(batch.column("shard").to_pylist()):
                    if shard not in shards:
                        shards[shard] = Leader(z.astype(float), n.astype(float))
                    shards[shard].learn(*_row(batch, i))
            for leader in shards.values():
                yield pa.RecordBatch.from_arrays([pa.array([leader.z.astype("<f4").tobytes()]), pa.array([leader.n.astype("<f4").tobytes()])], ["z", "n"])

        states = parts.mapInArrow(run, "z binary, n binary").collect()  # SHARDS rows
        if not states:
            break
        z, n = (np.mean([np.frombuffer(bytes(s[c]), "<f4").reshape(k, CELLS).astype(float) for s in states], axis=0) for c in ("z", "n"))
    return Leader(z, n).weights()


def _temperature(vectors: DataFrame, weights: np.ndarray, share: np.ndarray) -> float:
    """The temperature under which rows that weren't learned from are likeliest, each language by its share of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = [weights[:, at] @ x for at, x, _ in (_row(batch, i) for i in range(len(batch)))]
            yield pa.RecordBatch.from_arrays([batch.column("language"), pa.array(logits, pa.list_(pa.float64()))], ["language", "logits"])

    rows = vectors.where(F.col("shard") == SHARDS).mapInArrow(run, "language int, logits array<double>").toArrow()  # bounded by the sample
    if not len(rows):
        return 1.0
    logits, language = np.array(rows["logits"].to_pylist()), rows["language"].to_numpy()
    w = share[language] / np.bincount(language, minlength=len(share))[language]

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))[np.arange(len(language)), language]
        return float(-(w * np.log(np.maximum(p, 1e-300))).sum() / w.sum() + 1e-4 * log_t * log_t)

    low, high = np.log(0.02), np.log(50.0)
    for _ in range(60):  # golden section
        a, b = high - 0.618034 * (high - low), low + 0.618034 * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame) -> Model:
    """The model of the rows of ``docs`` (doc_id, text, lang) that have a lang and aren't held out.

    Document frequencies are of all of them, weights of about SAMPLE a language, by hashes of doc_id and text. Without
    rows there are no languages; with one language that is the answer.
    """
    learning = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out())
    found = {r["lang"]: r["n"] for r in learning.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    languages = sorted(found)
    if not languages:
        return Model([], np.zeros(CELLS), np.zeros((0, CELLS)), 1.0)
    frequency, texts = _frequencies(learning)
    idf = np.log((1 + texts) / (1 + frequency)) + 1
    h = F.xxhash64("doc_id", "text")
    wanted = F.create_map(*(F.lit(v) for name in languages for v in (name, min(1.0, SAMPLE / found[name]))))
    drawn = learning.where(F.pmod(h, F.lit(1 << 30)) < wanted[F.col("lang")] * (1 << 30))
    turn = F.xxhash64(h, F.lit(7))
    shard = F.when(F.pmod(turn, F.lit(CALIBRATES)) == 0, SHARDS).otherwise(F.pmod(F.shiftright(turn, 8), F.lit(SHARDS))).cast("int")
    vectors = _vectors(drawn.select("text", "lang", shard.alias("shard"), turn.alias("turn")), idf, languages)
    weights = _learned(vectors, len(languages))
    total = sum(found.values())
    return Model(languages, idf, weights, _temperature(vectors, weights, np.array([found[x] / total for x in languages])))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text; other columns are ignored).

    A null text, or one without a letter, is ``und`` with score 0, as is every text where no language was learned. Rows
    without doc_id are not held out; repeated rows repeat; no rows give none. Equal scores go to the first name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            names, scores = model.of(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op12_ftrl_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, fit(docs))
