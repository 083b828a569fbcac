"""Phrases against plain counting, whatever the shards, maps and steps."""

import collections
import random
import re

import pytest

from sawmill.llm import collocations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, h long, n long, phrase string"


def brute(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        around = (q for (other, q), b in found.items() if other == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
        if next(around, None) is None:
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    got = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        got += [(r[0], i, *r[1:]) for i, r in enumerate(mine, 1)]
    return sorted(got)


def made(seed=1):
    r = random.Random(seed)
    fixed = ["new york city hall", "a b", "a a a a a a", "the old man and the sea", "Été über x", "q-r s't"]
    rows = []
    for i in range(160):
        words = []
        for _ in range(r.randint(0, 12)):
            words += r.choice(fixed).split() if r.random() < 0.5 else [r.choice("the of THE and a b z".split())]
            words.append(r.choice(["", "", "", ".", "\n", " ,", "\t", "\x0b"]))
        rows.append((i, " ".join(words), r.choice(["en", "en", "fr", None])))
    rows += [(500, None, "en"), (501, "", "en"), (502, " .,; \t", "xx"), (None, "the old man", "en"), (None, "the old man", "en"), (3, rows[3][1], rows[3][2]), (504, "a b " * 20_000, "de"), (505, "日本 語 " * 9 + "und", "und")]
    return rows


@pytest.mark.parametrize("least,shards,bits,step,known", [(8, 4, 1 << 22, 1_000_000, 2_000_000), (5, 2, 64, 50, 3), (12, 1, 1 << 12, 7, 40)])
def test_phrases_equal_plain_counting(spark, monkeypatch, least, shards, bits, step, known):
    for name, value in (("LEAST", least), ("SHARDS", shards), ("BITS", bits), ("STEP_WORDS", step), ("KNOWN", known), ("TOP", 40)):
        monkeypatch.setattr(collocations, name, value)
    rows = made()
    df = spark.createDataFrame([(i, t, lang, 1, 2, "x") for i, t, lang in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.collocations(df).collect())
    want = brute(rows, least, 40)
    assert got == want and len({w[0] for w in want}) >= 4 and any(len(w[2].split()) == 5 for w in want)


def test_nothing(spark):
    for rows in ([], [(1, None, None, 1, 1, ""), (2, " . ", "en", 1, 1, ""), (3, "few words", "en", 1, 1, "")]):
        assert collocations.collocations(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_scores_are_exact(spark):
    rows = [(2, 9 * 10**12 + 1, 10**14 + 7, [3 * 10**12 + 1, 9 * 10**12 + 1], [7 * 10**13 + 5, 9 * 10**12 + 1]), (3, 101, 10**14, [101, 500, 101], [101, 500, 101])]
    got = spark.createDataFrame(rows, "length tinyint, a long, n long, begins array<long>, ends array<long>").select(collocations._scores().alias("x")).collect()
    assert got[0]["x"]["score"] == 1000 * rows[0][1] * rows[0][2] // ((3 * 10**12 + 1) * (7 * 10**13 + 5))
    assert (got[1]["x"]["score"], got[1]["x"]["k"]) == (1000 * 101 * 10**14 // (101 * 500), 1)
