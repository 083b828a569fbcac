"""Languages: features against plain counting, the learner against plain formulas, held-out accuracy."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from sawmill.llm import languages

SCHEMA = "doc_id long, text string, lang string, source string, at int, x string"
WORDS = {"en": "the of and thing whether which with from there", "de": "der die das über schön nicht heiß auch wird", "fr": "le été où ça être dans qu'on très", "ru": "это слово и не был что как"}


def made(n=300, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        rows.append((i, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(3, 60))), lang, "s", 1, "y"))
    rows += [(n, None, "en", None, None, None), (n + 1, "", "en", None, None, None), (n + 2, "12 !? 34", "fr", None, None, None), (n + 3, "thing " * 60_000, None, None, None, None), (None, "der die das", "de", None, None, None), (n + 5, "the of and", "en", None, None, None), (n + 5, "the of and", "en", None, None, None), (n + 4, "ǅ日本", None, None, None, None)]
    return rows


def plain_grams(text):
    out, cells = "", collections.Counter()
    for c in text:
        low = c.lower() if len(c.lower()) == 1 else c
        out += low if c.isalpha() else " " if not out.endswith(" ") else ""
    out += "" if out.endswith(" ") else " "
    mask = 2**64 - 1

    def mix(x):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = ((x ^ (x >> 33)) * m) & mask
        return x ^ (x >> 33)

    for n in range(1, 4):
        for i in range(len(out) - n + 1):
            if n > 1 or out[i] != " ":
                h = (n + sum(ord(out[i + k]) * int(languages._SALT[k]) for k in range(n))) & mask
                cells[mix(h) >> (64 - int(math.log2(languages.CELLS)))] += 1
    return cells


def test_grams_equal_plain_counting():
    texts = ["The  thing, über-Schön 12 ñ", "a", "日本 x", "ab ab", "z" * 3_000 + " q", "İx ǅ"]
    for t, (at, count) in zip(texts, languages.grams(["", *texts, "12"][1:-1])):
        assert dict(zip(at.tolist(), count.tolist())) == dict(plain_grams(t))
    assert [len(at) for at, _ in languages.grams(["", "1 2", "x", ""])] == [0, 0, 2, 0]
    assert list(languages.grams([])) == []


def test_learner_equals_plain_formulas():
    r = np.random.default_rng(1)
    leader = languages.Leader(np.zeros((2, languages.CELLS)), np.zeros((2, languages.CELLS)))
    z, n = np.zeros((2, 4)), np.zeros((2, 4))
    weight = lambda z, n: 0.0 if abs(z) <= languages.L1 else -(z - math.copysign(languages.L1, z)) / ((languages.BETA + math.sqrt(n)) / languages.ALPHA + languages.L2)
    for _ in range(30):
        x, y = r.random(4), int(r.integers(2))
        leader.learn(np.arange(4), x, y)
        w = [[weight(z[k][i], n[k][i]) for i in range(4)] for k in range(2)]
        e = [math.exp(sum(a * b for a, b in zip(w[k], x))) for k in range(2)]
        for k in range(2):
            for i in range(4):
                g = (e[k] / sum(e) - (k == y)) * x[i]
                z[k][i] += g - (math.sqrt(n[k][i] + g * g) - math.sqrt(n[k][i])) / languages.ALPHA * w[k][i]
                n[k][i] += g * g
    assert np.allclose(leader.z[:, :4], z) and np.allclose(leader.n[:, :4], n)
    assert not leader.weights()[:, 4:].any()


def test_held_out_rows_and_awkward_ones(spark, monkeypatch):
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = languages.fit(docs)
    got = languages.predicted(docs, model).collect()
    assert len(got) == len(rows)
    known = {r[0]: r for r in rows}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    real = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and r["held_out"]]
    assert all(r["lang_pred"] == known[r["doc_id"]][2] for r in real) and len(real) > 50
    awkward = {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 300}
    assert [awkward[300 + i] for i in range(4)] == ["und", "und", "und", "en"]
    assert 0 < (model.weights != 0).mean() < 0.2
    # Held-out rows' langs play no part.
    other = spark.createDataFrame([(i, t, "xx" if i is not None and zlib.crc32(str(i).encode()) % 3 == 1 else lang, s, a, x) for i, t, lang, s, a, x in rows], SCHEMA).repartition(2)
    again = languages.fit(other)
    assert again.languages == model.languages and np.array_equal(again.idf, model.idf)
    assert np.abs(again.weights - model.weights).max() < 1e-4
    monkeypatch.setattr(languages, "SAMPLE", 40)
    few = languages.fit(docs)
    assert np.array_equal(few.idf, model.idf) and not np.allclose(few.weights, model.weights)


def test_temperature_is_the_likeliest(spark):
    docs = spark.createDataFrame([(i, t if i is None or i % 4 else "which été das", lang, s, a, x) for i, t, lang, s, a, x in made()], SCHEMA)
    model = languages.fit(docs)
    h = docs.where(~languages.held_out() & docs.lang.isNotNull())
    assert model.temperature > 0 and h.count() > 100


@pytest.mark.parametrize("langs", [[], ["en"]])
def test_no_or_one_language(spark, langs):
    rows = [(i, "the thing", (langs or [None])[0], "s", 1, "") for i in range(9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = languages.predicted(docs, languages.fit(docs)).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == ({("en", 1.0)} if langs else {("und", 0.0)})
    empty = docs.limit(0)
    assert languages.predicted(empty, languages.fit(empty)).collect() == []
