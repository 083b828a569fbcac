"""Byte-level BPE ids from the tokenizers library, each distinct piece encoded once.

A byte-level BPE tokenizer cuts a text into pieces by a fixed pattern and merges
inside a piece only, so a text's ids are those of its pieces one after another.
``PieceEncoder`` finds the pieces of a whole batch with numpy, has the library
encode the distinct pieces that it has not met yet, and puts the ids together.
Texts that the vectorised cut does not cover (characters from U+0250 on, straight
apostrophes, strings of added tokens) and tokenizers of another kind go to the
library whole, so the ids always equal ``Tokenizer.encode``.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Entries at which the memo of pieces drops those that it met in one batch only (about 150 bytes each).
MEMO_PIECES = 500_000
#: Characters that one vectorised step handles; bounds a worker's memory.
STEP_CHARS = 4_000_000
#: The vectorised cut covers code points below this.
COVERED = 0x250

_UNCOVERED = re.compile(f"['\\u{COVERED:04x}-\\U0010ffff]")
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = np.full(COVERED, _OTHER, np.uint8)
    for c in range(COVERED):
        if unicodedata.category(chr(c))[0] == "L":
            kinds[c] = _LETTER
        elif unicodedata.category(chr(c))[0] == "N":
            kinds[c] = _NUMBER
        elif chr(c).isspace() and not 0x1C <= c <= 0x1F:
            kinds[c] = _SPACE
    return kinds


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file, so that counts of two vocabularies never mix."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in ``points`` (code points of several texts, one after another).

    ``text_starts`` are the starts of the texts that are not empty. The pattern is
    `` ?L+ | ?N+ | ?[^sLN]+ |s+(?!S) |s+`` with no apostrophes in sight: runs of one
    class, where a run of white space gives its last character to what follows - as
    a prefix if it is a space, else as a piece of its own.
    """
    kind = _classes()[points]
    first = np.zeros(len(points) + 1, bool)
    first[text_starts] = first[-1] = True
    start = first[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    last = np.zeros(len(points), bool)  # last of a white-space run with something after it in its text
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:-1]
    start |= last
    joined = last & (points == 0x20)
    start[1:] &= ~joined[:-1]
    return np.flatnonzero(start)


class PieceEncoder:
    """Encodes batches of texts; ``encode`` returns all ids and each text's number of ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.by_piece = (
            spec.get("normalizer") is None
            and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
            and model.get("type") == "BPE" and not model.get("dropout")
        )
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.n_bytes = np.ones(1, np.int64)
        if self.by_piece:  # each character of a token in the vocabulary stands for one byte
            self.n_bytes = np.zeros(max(model["vocab"].values()) + 1, np.int64)
            self.n_bytes[list(model["vocab"].values())] = [len(t) for t in model["vocab"]]
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.met = np.zeros(0, np.int32)

    def _make_room(self) -> None:
        """Keeps what several batches had, as long as that is less than half of the memo."""
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > MEMO_PIECES // 2:
            return self._forget()
        names = list(self.memo)  # in the order of their rows
        length = np.diff(self.ends)[keep]
        ends = np.cumsum(length)
        self.ids = self.ids[np.repeat(self.ends[keep] - (ends - length), length) + np.arange(length.sum())]
        self.ends, self.met = np.concatenate([[0], ends]), self.met[keep]
        self.memo = {names[i]: k for k, i in enumerate(keep.tolist())}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of a space and letters: in a row they are cut as they are, so a
        call encodes many, and the tokens' lengths in bytes tell them apart."""
        runs = ["".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
        ids = np.concatenate(self._whole(runs))
        token_ends = np.cumsum(self.n_bytes[ids])
        word_ends = np.cumsum([len(w.encode()) for w in words])
        at = np.searchsorted(token_ends, word_ends)
        if not np.array_equal(token_ends[at], word_ends):
            raise ValueError("the tokenizer doesn't encode word by word")
        return ids, np.diff(at + 1, prepend=0)

    def _learn(self, pieces: list[str]) -> None:
        words = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        for some, (ids, n) in (
            (words, self._words(words) if words else (np.empty(0, np.uint32), [])),
            (rest := [p for p in pieces if not (p[0] == " " and p[1:].isalpha())], (np.concatenate([np.empty(0, np.uint32), *(found := self._whole(rest))]), [len(x) for x in found])),
        ):
            base = len(self.ends) - 1
            self.memo.update(zip(some, range(base, base + len(some))))
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n, dtype=np.int64)])
        self.met = np.concatenate([self.met, np.zeros(len(self.ends) - 1 - len(self.met), np.int32)])

    def _covered(self, text: str) -> bool:
        return not (_UNCOVERED.search(text) or any(t in text for t in self.added))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, counts, at = [], [], 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= STEP_CHARS):
                size += len(texts[end])
                end += 1
            ids, n = self._step(texts[at:end])
            parts.append(ids)
            counts.append(n)
            at = end
        return np.concatenate([np.empty(0, np.uint32), *parts]), np.concatenate([np.empty(0, np.int64), *counts])

    def _step(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        apart = [i for i, t in enumerate(texts) if t and not (self.by_piece and self._covered(t))]
        if not apart:
            return self._pieces(texts)
        whole = dict(zip(apart, self._whole([texts[i] for i in apart])))
        ids, n = self._pieces(["" if i in whole else t for i, t in enumerate(texts)])
        rows = np.split(ids, np.cumsum(n)[:-1])
        for i, x in whole.items():
            rows[i], n[i] = x, len(x)
        return np.concatenate(rows), n

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        chars = np.array([len(t) for t in texts], np.int64)
        if not chars.sum():
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        text_ends = np.cumsum(chars)
        starts = piece_starts(points, (text_ends - chars)[chars > 0])
        if joined.isascii():
            offsets = np.append(starts, len(points))
        else:
            offsets = np.append((starts + (np.cumsum(wide := points >= 0x80, dtype=np.int32) - wide)[starts]), len(data := joined.encode()))
        data = joined.encode() if joined.isascii() else data
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        known, codes = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        if len(self.memo) + len(known) > MEMO_PIECES:
            self._make_room()
        if new := [p for p in known if p not in self.memo]:
            self._learn(new)
        rows = np.fromiter(map(self.memo.__getitem__, known), np.int64, len(known))
        self.met[rows] += 1
        rows = rows[codes]
        begin = self.ends.astype(np.int32)
        length = np.diff(begin)[rows]
        ends = np.cumsum(length, dtype=np.int32)
        ids = self.ids[np.repeat(begin[rows] - (ends - length), length) + np.arange(ends[-1], dtype=np.int32)]
        upto = np.concatenate([[0], ends])[np.searchsorted(starts, np.concatenate([[0], text_ends]))]
        return ids, np.diff(upto)


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process: its memo serves all tasks that the worker runs."""
    return PieceEncoder(path)
