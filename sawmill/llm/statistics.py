"""Statistics of whole documents, of many at once; lang, source and labels play no part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import steps, texts_of
from .words import STEP_BYTES, WINDOW, U, Words, mix

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_stops", "n_marks", "n_other", "n_bytes", "n_different")


def _bytes(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


#: Bytes of each kind; all of them ASCII.
_SYMBOLS, _UPPER, _DIGITS = _bytes("#*$%&|<>"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("0123456789")
_STOPS, _MARKS, _OTHER = _bytes(".,;:"), _bytes("!?"), _bytes("=@^_~`\\{}[]()+-/\"'")


def counts(texts: list[str]) -> dict[str, np.ndarray]:
    """COUNTS of each text: words, code points in words, symbols, lines equal to an earlier
    line of the text, words in five-word windows that the text has twice or more, and more."""
    words = Words(texts)
    k = len(texts)
    if not k:
        return {c: np.zeros(0, np.int64) for c in COUNTS}
    begin = words.text_end - np.diff(words.text_end, prepend=0)
    data = words.data

    def each(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, begin, dtype=np.int64)

    word_chars = each((data & 0xC0) != 0x80) - each((data == 0x20) | ((data >= 9) & (data <= 13)))
    lines, dup = np.zeros(k, np.int64), np.zeros(k, np.int64)
    for i, t in enumerate(texts):
        if "\n" in t:
            real = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
            lines[i], dup[i] = len(real), len(real) - len(set(real))
        else:
            lines[i] = 1
    hashed, at = words.windows()
    n_windows = np.maximum(words.n - WINDOW + 1, 0)
    full = np.repeat(words.n >= WINDOW, np.diff(at))
    owner = np.repeat(np.arange(k), np.diff(at))[full]
    key = mix(hashed[full] ^ (owner.astype(U) * U(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    place = words.first[:-1][owner] + np.arange(len(owner)) - (np.cumsum(n_windows) - n_windows)[owner]
    step = np.zeros(len(words.begin) + WINDOW + 1, np.int32)
    np.add.at(step, place[twice], 1)
    np.add.at(step, place[twice] + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step)[: len(words.begin)] > 0)])
    word_owner = np.repeat(np.arange(k), words.n)
    word_key = np.sort(mix(words.hashes() ^ (word_owner.astype(U) * U(0x9E3779B97F4A7C15))) >> U(20) | (word_owner.astype(U) << U(44)))
    new = np.ones(len(word_key), bool)
    new[1:] = word_key[1:] != word_key[:-1]
    return {
        "n_words": words.n.astype(np.int64), "word_chars": word_chars, "n_symbols": each(_SYMBOLS[data]), "n_dup_lines": dup,
        "n_repeat_words": covered[words.first[1:]] - covered[words.first[:-1]], "n_lines": lines, "n_upper": each(_UPPER[data]), "n_digits": each(_DIGITS[data]),
        "n_stops": each(_STOPS[data]), "n_marks": each(_MARKS[data]), "n_other": each(_OTHER[data]), "n_bytes": words.text_end - begin - 1,
        "n_different": np.bincount((word_key[new] >> U(44)).astype(np.int64), minlength=k),
    }


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of ``docs`` and COUNTS of its text (null: no words)."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"{c} long" for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps([whole], chars=STEP_BYTES):
                got = counts(texts_of(batch))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], [*keep, *COUNTS])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
