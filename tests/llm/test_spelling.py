"""Spelling variants against plain loops."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sawmill.llm import spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, word string, n long, own string"


def brute_counts(rows):
    found = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words = brute_counts(rows)
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 5 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


def made(seed=1):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdeéßzñ×÷ÿ") for _ in range(r.randint(6, 9))) for _ in range(12)]
    words = []
    for s in stems:
        for k, times in enumerate((200, 30, 5, 6, 5)):
            w, at = s, r.randrange(len(s))
            for _ in range(k if k < 4 else 1):
                kind, at = r.randrange(3), r.randrange(len(w))
                w = w[:at] + w[at + 1 :] if kind == 0 else w[:at] + r.choice("abcÀ") + w[at + (kind == 2) :]
            words += [w.upper() if r.random() < 0.3 and "ß" not in w and "ÿ" not in w else w] * times
    r.shuffle(words)
    rows = [(i, r.choice([" ", "-", "\n", "Ā", "日"]).join(words[i * 9 : i * 9 + 9])) for i in range(len(words) // 9 + 1)]
    rows += [(None, " ".join(words[:40])), (None, None), (7, ""), (8, None), (3, rows[3][1]), (3, rows[3][1]), (-1, ("ab" * 40_000 + " ") * 5), (-2, ("ab" * 40_000 + "c ") * 30)]
    return rows


@pytest.mark.parametrize("home,coming,groups", [(1_024, 4_096, 6), (3, 2, 2), (2, 5, 1)])
def test_variants_equal_plain_loops(spark, monkeypatch, home, coming, groups):
    monkeypatch.setattr(spelling, "HOME", home)
    monkeypatch.setattr(spelling, "COMING", coming)
    monkeypatch.setattr(spelling, "GROUPS", groups)
    rows = made()
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.spelling_variants(df).collect()), key=lambda r: r[0])
    want = brute(rows)
    assert got == want
    assert any(f and f != r for _, f, r, *_ in want) and any(n > 1 for *_, n, _ in want)


def test_nothing(spark):
    for rows in ([], [(1, None, None, None, None), (2, "", None, None, None), (3, "short words", None, None, None)]):
        assert spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_near_pairs_equal_plain_loops():
    r = random.Random(2)
    words = sorted({"".join(r.choice("abé") for _ in range(6)) for _ in range(150)})
    longer = sorted({"".join(r.choice("abé") for _ in range(7)) for _ in range(150)})
    for b in (words, longer):
        i, j = spelling.near_pairs(pa.array(words), pa.array(b))
        assert sorted(zip(i.tolist(), j.tolist())) == [(x, y) for x, v in enumerate(words) for y, w in enumerate(b) if one_edit(v, w)]


def test_checksums_of_runs():
    r = random.Random(3)
    data = bytes(r.randrange(256) for _ in range(5_000))
    begin = np.array([r.randrange(4_000) for _ in range(300)])
    size = np.array([r.choice([0, 1, 3, 9, 48, 49, 700]) for _ in range(300)])
    state = np.array([zlib.crc32(str(i).encode()) for i in range(300)], np.uint32)
    got = spelling._continued(state, np.frombuffer(data, np.uint8), begin, size)
    assert got.tolist() == [zlib.crc32(data[b : b + n], int(s)) for b, n, s in zip(begin.tolist(), size.tolist(), state.tolist())]
