"""The operators against brute force on small tables with every awkward row."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from itertools import combinations

import numpy as np
import pytest

from sawmill.llm import common, encoding, fingerprints, ngram_join, outliers, packing, pieces, pii, quality, statistics, token_counts, urls, wavelet, words
from sawmill.llm.common import scratch, tokenizer_path
from sawmill.llm.components import components

BPE, SPM = "byte_bpe_50k.json", "piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, terms string, n_words long, _h long, class string"


def text_of(r, n):
    return " ".join(r.choice(["the", "of", "stone", "river", "walked", "Über", "été", "light", "12", "green.", "house,"]) + str(r.randint(0, 40)) for _ in range(n))


def rows():
    r = random.Random(3)
    base = text_of(r, 120)
    near = base.split()
    near[60] = "changed"
    far = base.split()
    for i in range(5, 120, 7):
        far[i] = f"x{i}"
    texts = [text_of(r, r.randint(1, 60)) for _ in range(20)] + [base, base, " ".join(near), " ".join(near[:118]), " ".join(far)]
    texts += [None, "", "   \n\t ", "one", "one", "a b c d", "A B C D", "\x0b", "it's <|endoftext|> 日本 😀 x", "a\n\na\nb\n" * 20, ("long " * 30_000) + "end", "wörd" * 20_000]
    texts += ["mail a.b@c.org_x@d.io, 1.2.3.4.5.6.7.8 +1 (499) 555-6503 4539 1488 0343 6467 999.0.0.1", "1" * 30_000, "a" * 30_000 + "@", "+" * 5_000 + "1"]
    out = [(i, t, r.choice(["en", "de", None]), r.choice(["s0", "s1", None]), None if t is None else len(t), "extra", 1, 2, "c") for i, t in enumerate(texts)]
    out += [out[3], out[20], (None, base, "en", "s0", 1, None, None, None, None), (None, "nameless words that stand alone here", None, None, None, None, None, None, None), (-5, text_of(r, 30), "en", "s0", 0, "", 0, 0, "")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return (i is not None, i or 0)


# --- 1


def test_fingerprints_follow_the_next_document(docs):
    got = sorted(fingerprints.fingerprint_versions(docs).collect(), key=lambda r: (key(r["doc_id"]), r["n_chars"], r["fingerprint"]))
    want = sorted(((r[0], r[1] or "") for r in rows()), key=lambda r: (key(r[0]), r[1].encode()))
    assert len(got) == len(want)
    versions = [fingerprints.edited(a[1], b[1]) for a, b in zip(want, want[1:] + want[:1])]
    assert sorted(hashlib.sha256(v.encode()).hexdigest() for v in versions) == sorted(r["edited_sha256"] for r in got)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    prints = {}
    for r in got:
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert len(prints[3]) == 1 and prints[3] != prints[4]


def test_digests_are_the_same_wherever_a_text_stands():
    r = random.Random(4)
    texts = ["a b c d e f g h i j k l", "it is as we do so to be or no at me", "é a", "x", "", " y z", "ab\ncd ef", *(" ".join(r.choice(["a", "of", "Ü", "to", "tree"]) for _ in range(r.randint(1, 40))) for _ in range(60))]
    alone = [fingerprints.digests([t])[0].tolist() for t in texts]
    for t, want in zip(texts, alone):
        digest, n = fingerprints.digests([x for other in texts for x in (other, t)])
        got = np.split(digest, np.cumsum(n)[:-1])[1::2]
        assert all(g.tolist() == want for g in got)


def test_equal_neighbours_are_wholly_alike(spark):
    r = random.Random(12)
    table = [(i, t) for i, t in enumerate(t for _ in range(80) for t in [" ".join(r.choice(["a", "of", "Ü", "to", "tree"]) for _ in range(r.randint(1, 30)))] * r.randint(1, 4))]
    got = {x["doc_id"]: x for x in fingerprints.fingerprint_versions(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()}
    for (i, t), (j, u) in zip(table, table[1:] + table[:1]):
        assert t != u or (got[i]["near_next"] == 1 and got[i]["next_differs_by"] == 0 and got[i]["fingerprint"] == got[j]["fingerprint"])
        sets = [set(fingerprints.digests([x])[0].tolist()) for x in (t, u, fingerprints.edited(t, u))]
        assert got[i]["next_differs_by"] == len(sets[0] ^ sets[1]) and got[i]["edited_differs_by"] == len(sets[0] ^ sets[2])
        assert abs(got[i]["near_edited"] - (1 - len(sets[0] ^ sets[2]) / max(1, len(sets[0]) + len(sets[2])))) < 1e-12


def test_versions_of_a_table(spark, empty):
    r = random.Random(13)
    old = [(i, text_of(r, r.randint(0, 400))) for i in range(60)] + [(100, "only old"), (None, "nameless"), (102, None)]
    new = [(i, t if i % 3 else " ".join(w for w in t.split() if r.random() > 0.3)) for i, t in old[:60]] + [(101, "only new, of more words than one paragraph has"), (102, "")]
    got = {x["doc_id"]: x for x in fingerprints.compare(*(spark.createDataFrame(t, "doc_id long, text string") for t in (old, new))).collect()}
    a, b = dict(old), dict(new)
    assert set(got) == {i for i in {**a, **b} if i is not None}
    for i, x in got.items():
        p, q = (set(fingerprints.digests([d.get(i) or ""])[0].astype(np.int64).tolist()) for d in (a, b))
        assert x["added"] == sorted(q - p) and x["removed"] == sorted(p - q)
        assert abs(x["likeness"] - (1 - len(p ^ q) / max(1, len(p) + len(q)))) < 1e-12
    prints = {x["doc_id"]: x for x in fingerprints.fingerprint(spark.createDataFrame(old, "doc_id long, text string")).collect()}
    assert len(prints) == len(old) and prints[5]["n_paragraphs"] == len(fingerprints.digests([a[5]])[0])
    assert fingerprints.compare(empty, empty).collect() == [] and fingerprints.fingerprint(empty).collect() == []


def test_stored_fingerprints_are_compared(spark, empty):
    r = random.Random(17)
    old = [(i, text_of(r, r.randint(0, 600))) for i in range(60)] + [(100, "only old"), (None, "nameless"), (102, None), (103, text_of(r, 90_000))]
    new = [(i, t if i % 4 == 0 else " ".join(w for w in (t or "").split() if r.random() > (0.01, 0.05, 0.5)[i % 3])) for i, t in old[:60]] + [(101, "only new"), (102, ""), (103, old[-1][1] + " and more")]
    new += [(0, "another row of it"), (5, text_of(r, 3_000))]
    docs = [spark.createDataFrame(t, "doc_id long, text string, fingerprint int").drop("fingerprint") for t in ([(*x, 1) for x in old], [(*x, 1) for x in new])]
    prints = [fingerprints.fingerprint(d, size) for d, size in zip(docs, (3, 5))]
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    exact = order(fingerprints.compare(*docs))
    few = order(fingerprints.compare_stored(*prints))
    stuck = {x[0] for x in few if x[1] is None}
    assert 5 in stuck and 4 not in stuck and 103 not in stuck and all(x[2] is None and x[3] is None for x in few if x[1] is None)
    assert [x for x in few if x[0] not in stuck] == [x for x in exact if x[0] not in stuck] and len(few) == len(exact)
    assert order(fingerprints.compare_stored(*prints, docs)) == exact
    assert fingerprints.compare_stored(*(fingerprints.fingerprint(empty) for _ in range(2)), (empty, empty)).collect() == []
    with pytest.raises(ValueError, match="fingerprint"):
        fingerprints.size_of("AAAA")


def test_fingerprints_of_nothing(empty):
    assert fingerprints.fingerprint_versions(empty).collect() == []


def test_peeling_recovers_differences():
    r = random.Random(1)
    texts = [text_of(r, 400) for _ in range(6)]
    texts += [t.replace("river", "lake", 2) for t in texts]
    digest, n = fingerprints.digests(texts)
    parts = [set(x.tolist()) for x in np.split(digest, np.cumsum(n)[:-1])]
    left, right = np.repeat(np.arange(12), 12), np.tile(np.arange(12), 12)
    assert fingerprints.differences(digest, n, left, right).tolist() == [len(parts[a] ^ parts[b]) for a, b in zip(left, right)]
    sketch = fingerprints.Sketches(1, 5)
    sketch.add(np.zeros(n[0], int), digest[: n[0]])
    small = fingerprints.Sketches(1, 4)
    small.add(np.zeros(n[0], int), digest[: n[0]])
    assert sketch.fold().texts(n[:1]) == small.texts(n[:1])


# --- 2, 6, 9: tokens


def test_pieces_are_encoded_as_the_library_does():
    r = random.Random(5)
    alphabet = "ab Z9é½²\n\t \r\xa0'.,!-_日😀\x1c\x85"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(800)] + [x[1] or "" for x in rows()] + ["<|endoftext|>", "a <|endoftext|>b"]
    e = encoding.PieceEncoder(tokenizer_path(BPE))
    ids, n = e.encode(texts)
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_a_full_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(encoding, "MEMO_PIECES", 50)
    e = encoding.PieceEncoder(tokenizer_path(BPE))
    r = random.Random(5)
    for _ in range(10):
        texts = [text_of(r, 30) for _ in range(5)]
        assert e.encode(texts)[0].tolist() == [i for x in e.tokenizer.encode_batch(texts, add_special_tokens=False) for i in x.ids]


def test_other_tokenizers_are_encoded_whole():
    e = encoding.PieceEncoder(tokenizer_path("word_bpe_49k.json"))
    assert not e.by_piece
    assert e.encode(["Some words", ""])[0].tolist() == e.tokenizer.encode("Some words", add_special_tokens=False).ids


def test_wavelet_matrix():
    x = np.random.default_rng(0).integers(0, 700, 5_000).astype(np.uint32)
    doc_ids, n, m = wavelet.load(wavelet.dump([None, -3, 9], np.array([1000, 0, 4000]), x))
    assert doc_ids == [None, -3, 9] and n.tolist() == [1000, 0, 4000] and (m.decode() == x).all()
    for i in range(0, 5_000, 61):
        v = int(x[i])
        assert m.access(i) == v and m.rank(v, i) == (x[:i] == v).sum() and m.select(v, m.rank(v, i)) == i
        assert (m.places(v) == np.flatnonzero(x == v)).all()
    assert m.rank(9_999_999, 10) == 0 and len(m.places(9_999_999)) == len(m.places(700)) == len(m.places(-1)) == 0
    with pytest.raises(IndexError):
        m.select(int(x[0]), 5_000)
    with pytest.raises(ValueError, match="shard"):
        wavelet.load(b"WVM1" + bytes(80))


def test_lookups_inflate_few_blocks(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 64)
    for n, top in ((0, 1), (1, 9), (511, 2), (512, 2), (513, 2), (70_000, 40_000)):
        x = np.minimum(np.random.default_rng(n).zipf(1.3, n), top).astype(np.uint32)
        m = wavelet.load(wavelet.dump([1], np.array([n]), x))[2]
        assert (m.decode() == x).all()
        for i in range(0, n, 997):
            m = wavelet.load(wavelet.dump([1], np.array([n]), x))[2] if i < 5_000 else m
            before = sum(p.blocks.inflated for p in m.planes)
            assert m.access(i) == x[i] and sum(p.blocks.inflated for p in m.planes) - before <= m.bits
            before = sum(p.blocks.inflated for p in m.planes)
            assert m.rank(int(x[i]), i) == (x[:i] == x[i]).sum() and sum(p.blocks.inflated for p in m.planes) - before <= 2 * m.bits
            assert m.select(int(x[i]), m.rank(int(x[i]), i)) == i
        for v in {0, 1, 2, top, top + 1}:
            assert (m.places(v) == np.flatnonzero(x == v)).all()


def test_all_places_of_a_token_at_once():
    r = np.random.default_rng(3)
    x = np.where(r.random(1_000_000) < 0.18, 17, r.integers(0, 50_000, 1_000_000)).astype(np.uint32)
    m = wavelet.load(wavelet.dump([1], np.array([len(x)]), x))[2]
    assert (m.places(17) == np.flatnonzero(x == 17)).all()
    assert sum(p.blocks.inflated for p in m.planes) <= m.bits * (len(m.planes[0].blocks) + 2)  # each once, and two for the range


def test_shards_hold_all_ids_in_order(spark, docs, monkeypatch):
    path = scratch(spark)
    wavelet.write_shards(docs, tokenizer_path(BPE), path)
    got = sorted(wavelet.read_documents(spark, path).collect(), key=lambda r: r["start"])
    tokenizer = encoding.PieceEncoder(tokenizer_path(BPE)).tokenizer
    want = [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in sorted(rows(), key=lambda r: (key(r[0]), (r[1] or "").encode()))]
    at = 0
    assert len(got) == len(want)
    for g, (i, ids) in zip(got, want):
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_tokens_are_looked_up_in_the_files(spark, docs):
    path = scratch(spark)
    few = docs.where("doc_id < 30")
    wavelet.write_shards(few, tokenizer_path(BPE), path)
    tokenizer = encoding.PieceEncoder(tokenizer_path(BPE)).tokenizer
    ids = [(r["doc_id"], tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in few.collect()]
    some = [2, ids[0][1][0], ids[7][1][3], 50_000, 9_999_999]
    assert {r["id"]: r["n"] for r in wavelet.count_tokens(spark, path, some).collect()} == {t: sum(x.count(t) for _, x in ids) for t in some}
    for t in some:
        got = sorted((r["doc_id"], r["position"]) for r in wavelet.occurrences(spark, path, t).collect())
        assert got == sorted((i, k) for i, x in ids for k, v in enumerate(x) if v == t)


def test_shards_of_nothing(spark, empty):
    path = scratch(spark)
    wavelet.write_shards(empty, tokenizer_path(BPE), path)
    assert wavelet.read_documents(spark, path).collect() == []
    assert wavelet.occurrences(spark, path, 2).collect() == [] and wavelet.count_tokens(spark, path, [2]).collect() == []


def test_token_counts_come_from_the_cache(spark, docs, empty):
    cache, path = scratch(spark), tokenizer_path(BPE)
    tokenizer = encoding.PieceEncoder(path).tokenizer
    want = sorted(((r[0], len((r[1] or "").encode()), len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows()), key=lambda r: (key(r[0]), r))
    for _ in range(2):
        got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs.where("doc_id < 30"), path, cache).collect()), key=lambda r: (key(r[0]), r))
        assert got == [w for w in want if w[0] is not None and w[0] < 30]
    first = spark.read.parquet(cache).count()
    assert first == len({r[1] or "" for r in rows() if r[0] is not None and r[0] < 30})
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, path, cache).collect()), key=lambda r: (key(r[0]), r))
    assert got == want
    model = token_counts.count_tokens(docs, tokenizer_path(SPM), cache).collect()
    assert len(model) == len(want) and {r["n_tokens"] for r in model} != {w[2] for w in want}
    assert token_counts.count_tokens(empty, path, scratch(spark)).collect() == []


def brute_bins(counts, capacity):
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [(b, i) for i, b in enumerate(bins) if b >= length]
            if fit:
                bins[min(fit)[1]] -= length
            else:
                bins.append(capacity - length)
    return sorted(bins)


def test_runs_are_best_fit_decreasing():
    for seed in range(150):
        r = random.Random(seed)
        capacity = r.choice([7, 20, 64])
        counts = {r.randint(1, capacity): r.randint(1, 30) for _ in range(r.randint(1, 12))}
        bins = {}
        by = {}
        for run in packing.place(counts, capacity):
            by.setdefault(run[0], []).append(run)
        for length, runs in by.items():
            runs.sort(key=lambda x: x[1])
            for i, (_, rank, each, first, offset) in enumerate(runs):
                for k in range((runs[i + 1][1] if i + 1 < len(runs) else counts[length]) - rank):
                    bins.setdefault(first + k // each, []).append((offset + k % each * length, length))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
        assert sorted(capacity - sum(x for _, x in b) for b in bins.values()) == brute_bins(counts, capacity)


def test_packing(docs, empty):
    got = packing.pack(docs, tokenizer_path(BPE), 64).collect()
    tokenizer = encoding.PieceEncoder(tokenizer_path(BPE)).tokenizer
    want = sorted(((r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in rows()), key=lambda r: (key(r[0]), r[1]))
    assert sum(r["length"] for r in got) == sum(len(ids) for _, ids in want)
    one = {i: ids for i, ids in want if i is not None and [w[0] for w in want].count(i) == 1}
    for r in got:
        if r["doc_id"] in one:
            part = one[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
            assert len(one[r["doc_id"]]) > 64 or r["piece"] == 0
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    counts = {}
    for r in got:
        counts[r["length"]] = counts.get(r["length"], 0) + 1
    assert len(bins) == len(brute_bins(counts, 64))
    assert packing.pack(empty, tokenizer_path(BPE)).collect() == []


def test_packed_sequences_have_their_ids(docs, monkeypatch):
    monkeypatch.setattr(packing, "BATCH_TOKENS", 200)
    tokenizer = encoding.PieceEncoder(tokenizer_path(BPE)).tokenizer
    got, sequences = {}, {}
    for r in packing.pack(docs, tokenizer_path(BPE), 64).collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        got.setdefault(r["doc_id"], []).append((r["start"], ids))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], ids))
    want = {}
    for i, text, *_ in rows():
        want.setdefault(i, []).append(tokenizer.encode(text or "", add_special_tokens=False).ids + [0])
    for i, texts in want.items():
        if len(texts) == 1:
            assert [t for _, ids in sorted(got[i]) for t in ids] == texts[0]
    assert sorted(t for s in got.values() for _, ids in s for t in ids) == sorted(t for texts in want.values() for ids in texts for t in ids)
    assert all(sum(len(ids) for _, ids in s[:k]) == s[k][0] for s in map(sorted, sequences.values()) for k in range(len(s)))


# --- 3


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(table):
    sets = [shingles(r[1]) for r in table]
    name = list(range(len(table)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(table)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                name[root(i)] = root(j)
    least = {}
    for i, r in enumerate(table):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(root(i))) for i, r in enumerate(table)), key=lambda r: (key(r[0]), r[1], key(r[2])))


def test_groups_equal_all_pairs(spark, docs, empty):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(docs).collect()), key=lambda r: (key(r[0]), r[1], key(r[2])))
    assert got == brute_groups(rows())
    assert ngram_join.similar_groups(empty).collect() == []


def test_groups_of_many_small_and_chained_sets(spark):
    r = random.Random(11)
    table = []
    for i in range(260):
        kind = i % 4
        if kind == 0:
            w = [r.choice("abc") for _ in range(r.randint(1, 12))]
        elif kind == 1:  # a chain: each one shifted by a few words
            w = [f"c{k}" for k in range(i, i + 60)]
        elif kind == 2:
            w = [f"n{k}" if r.random() > 0.02 else f"z{r.randint(0, 9)}" for k in range(90)]
        else:
            w = ["same", "passage", "of", "ten", "words", "that", "many", "documents", "do", "share"] + [f"u{i}"] * r.randint(0, 4)
        table.append((i, " ".join(w)))
    got = sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.similar_groups(spark.createDataFrame(table, "doc_id long, text string")).collect()), key=lambda x: (key(x[0]), x[1], key(x[2])))
    assert got == brute_groups(table)


def test_groups_write_less_than_their_texts(spark, monkeypatch):
    r = random.Random(5)
    table = [(i, " ".join(f"w{r.randint(0, 9999)}" for _ in range(400))) for i in range(200)]
    table += [(200 + i, table[i][1] + " and more") for i in range(20)] + [(300 + i, table[i][1].upper()) for i in range(20)]
    sizes, save = [], ngram_join.saved

    def measured(df, path=None):
        out = save(df, path)
        sizes.append(sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles()))
        return out

    monkeypatch.setattr(ngram_join, "saved", measured)
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.similar_groups(spark.createDataFrame(table, "doc_id long, text string")).collect())
    assert got == brute_groups(table)
    assert max(sizes) < sum(len(t) for _, t in table) / 3


def test_one_of_each_group_stays(docs):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and set(ids) == {c for i, _, c in brute_groups(rows()) if i == c and i is not None}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_subsets_and_boundary():
    assert ngram_join.first_shingles(5) == 2 and ngram_join.first_shingles(4) == 1 and ngram_join.first_shingles(100) == 21
    assert ngram_join.boundary({4: 1}, 0.0) == 4 and ngram_join.boundary({9: 10}, 0.0) == 3
    assert ngram_join.boundary({5: 10}, 50.0) > 6


# --- 4

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    luhn = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]


def brute_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m.group())]


def test_personal_data_equals_the_patterns(spark, empty):
    r = random.Random(2)
    bits = ["a", "@", "b.c", ".", " ", "-", "1.2", "4539", "1488", "0343", "6467", "+", "(", ")", "12", "255", "300.", "é", "😀", "x_", "%", "\n"]
    table = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for i in range(600)]
    table += [(1000 + i, x[1]) for i, x in enumerate(rows()) if not (x[1] or "").startswith("a" * 100)]
    got = {x["doc_id"]: x for x in pii.personal_data(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    for i, t in table:
        spans = brute_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), (t, spans, got[i]["spans"])
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in spans) for k in PATTERNS]
    assert pii.personal_data(empty).collect() == []


def test_terms_that_give_a_value_away(spark):
    table = [(i, f"note {w} about the clerk Zorblax write a.b@x.org soon {w}") for i, w in enumerate(["ash", "bee", "cow", "dog"])]
    table += [(10 + i, f"the plain text {i} has words about the clerk and nothing soon, write") for i in range(40)] + [(60, None), (61, "")]
    df = spark.createDataFrame(table, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_data(df).collect()}
    assert all(spans[i].startswith("email:39:48,term:") for i in range(4)) and all(not spans[i] for i in spans if i >= 10)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert "Zorblax" not in clean[0] and "a.b@x.org" not in clean[0] and "the clerk" in clean[0]
    assert clean[60] is None and clean[61] == "" and clean[10] == table[4][1]


def test_terms_of_many_texts_of_a_value_are_removed(spark):
    table = [(i, f"note {i} about the clerk Zorblax write a.b@x.org soon") for i in range(5)] + [(9, "note about the clerk Grimwick write c.d@x.org soon")]
    table += [(10 + i, f"the plain note {i} has words about the clerk and nothing soon, write") for i in range(240)]
    share = {m: math.log(246 / m * m / (m + pii.DOUBT**2)) / math.log(247 / m) for m in (1, 5)}
    assert pii.GENERALISED <= share[1] < pii.REMOVED <= share[5]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert clean[3] == "note 3 about the clerk  write [EMAIL] soon" and clean[9] == "note about the clerk [email term] write [EMAIL] soon"
    assert all(clean[i] == t for i, t in table if i >= 10)


def test_terms_beside_a_value_of_one_text(spark):
    table = [(0, "the clerk Zorblax write a.b@x.org soon about Grimwick, Zorblax"), (1, "the clerk write c.d@x.org soon about quintal")]
    table += [(10 + i, f"plain text {i} of the clerk and nothing soon, about a write") for i in range(120)] + [(200, "a quintal"), (201, table[0][1])]
    df = spark.createDataFrame(table, "doc_id long, text string")
    text = {i: t for i, t in table}
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_data(df).collect()}
    at = {i: [text[i][int(a) : int(b)] for k, a, b in (x.split(":") for x in s.split(",") if x) if k == "term"] for i, s in spans.items()}
    assert at == {**{i: [] for i in text}, 0: ["Zorblax", "Grimwick", "Zorblax"], 201: ["Zorblax", "Grimwick", "Zorblax"]}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert clean[0] == "the clerk [email term] write [EMAIL] soon about [email term], [email term]"


def test_no_term_that_passes_is_left_uncounted(spark):
    table = spark.createDataFrame([(3, 3, 7)], "n_both long, n_value long, n_near long")
    for texts, passes in ((10**7, False), (10**11, True)):  # more than twice as many texts as have the value
        assert table.select(pii._share(texts, "n_near") >= pii.GENERALISED).first()[0] == passes
    rows = spark.createDataFrame([(b, v, t) for b in range(1, 6) for v in range(b, 8) for t in range(b, 40)], "n_both long, n_value long, n_term long")
    share = {(r[0], r[1], r[2]): r[3] for r in rows.select("*", pii._share(5_000, "n_term")).collect()}
    assert all(share[b, v, t] > share[b, v, t + 1] for b, v, t in share if t < 39)


def brute_terms(texts):
    """The disclosing terms of a corpus, by plain counting of its different texts."""
    import regex

    texts = sorted(set(texts))
    words = [set(regex.findall(r"[\p{L}\p{M}]+", t.lower())) for t in texts]
    near = set()
    for at, t in enumerate(texts):
        for k, a, b in brute_spans(t):
            blank = lambda x: regex.sub(r"[^\s]*[@0-9][^\s]*", " ", x).lower()
            before, after = (regex.findall(r"[\p{L}\p{M}]+", blank(x)) for x in (t[max(0, a - pii.REACH) : a], t[b : b + pii.REACH]))
            near |= {(f"{k}:{t[a:b].lower()}", w, at) for w in [*before[-pii.NEAR :], *after[: pii.NEAR]]}
    told, z = set(), pii.DOUBT
    for value, word in {(v, w) for v, w, _ in near}:
        n_value, n_both = len({at for v, _, at in near if v == value}), len({at for v, w, at in near if (v, w) == (value, word)})
        n = sum(word in x for x in words)
        p = n_both / n
        low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        if math.log(len(texts) * low / n_value) / math.log((len(texts) + 1) / n_value) >= pii.GENERALISED:
            told.add(word)
    return told


@pytest.mark.parametrize("bits", [common.BITS, 64])
def test_terms_equal_plain_counting(spark, monkeypatch, bits):
    import regex

    monkeypatch.setattr(common, "BITS", bits)
    r = random.Random(21)
    usual, rare, values = [f"usual{c}" for c in "abcdefgh"], [f"rare{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"], ["a.b@x.org", "C.d@x.org", "10.2.3.4", "+1 499 555 6503", "e@f.gh"]
    texts = []
    for i in range(300):
        w = [r.choice(usual) for _ in range(r.randint(0, 12))] + [r.choice(rare) for _ in range(r.random() < 0.4)]
        r.shuffle(w)
        if i % 6 == 0:
            v = r.randrange(len(values))
            w[len(w) // 2 : len(w) // 2] = [f"Owner{'pqrst'[v]}", values[v], r.choice(["soon", "Ünder", "owner"])]
        texts.append(" ".join(w))
    texts += ["Hapax a@b.cd hapaxtoo", "hapax once more", *[texts[0]] * 40, *["Manycopies z@y.xx here"] * 50]
    told = brute_terms(texts)
    assert {"ownerp", "hapaxtoo", "manycopies"} <= told and not told & {"hapax", "owner", *usual}
    got = {x["doc_id"]: x["spans"] for x in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    for i, t in enumerate(texts):
        base = brute_spans(t)
        terms = [("term", m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{M}]+", t) if m.group().lower() in told and not any(a < m.end() and m.start() < b for _, a, b in base)]
        assert got[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in [*base, *terms]), (t, told)


def test_sanitised_keeps_rows_and_columns(docs):
    out = pii.sanitised(docs)
    assert out.columns == docs.columns and out.count() == len(rows())
    assert all("@c.org" not in (r["text"] or "") for r in out.collect())


# --- 5, 7


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    twice = {k for v in seen.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice), len(set(w))


def test_counts_equal_plain_loops():
    texts = [r[1] or "" for r in rows()] + ["a b c d e f a b c d e\n\n \nx\nx", "\r\nx\r\nx\n", "#*$%&|<> #", "😀 é y"]
    got = statistics.counts(texts)
    for i, t in enumerate(texts):
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_different")) == brute_counts(t), t[:50]
    assert all(len(v) == 0 for v in statistics.counts([]).values())


def test_windows_have_their_words():
    hashed, at = words.Words(["a b c d e f", "", "x", "a b c d e"]).windows()
    assert np.diff(at).tolist() == [2, 0, 1, 1] and hashed[0] == hashed[3] and hashed[0] != hashed[1]


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(9)
    table, labels = [], []
    for i in range(600):
        good = i % 5 > 0
        w = [r.choice(["stone", "river", "walked", "light", "green.", "house,"]) + str(r.randint(0, 400)) for _ in range(r.randint(20, 90))]
        table.append((i, " ".join(w if good else [x.upper() + "!!" if i % 2 else x + "$$" for x in w]), "en", f"s{i % 2}", 0))
        labels.append((i, int(good), 0))
    labels += [(None, 1, 0), (5, None, 0)]
    return spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def plain_mcd(x):
    """The estimate of least determinant by the same starts and steps, over an array."""
    n = len(x)
    lower = lambda v, q: np.sort(v, 0)[int(np.ceil(q * n)) - 1]

    def step(m, w):
        factor = np.zeros((outliers.P, outliers.P))
        factor[np.tril_indices(outliers.P)] = w
        d = (((x - m) @ factor.T) ** 2).sum(1)
        near = x[d <= lower(d, outliers.HELD)]
        mean = near.mean(0)
        return outliers._estimate(mean, outliers.CONSISTENCY * (near.T @ near / len(near) - np.outer(mean, mean)))

    middle = lower(x, 0.5)
    spread = lower(np.abs(x - middle), 0.5) * 1.4826 + outliers.FLOOR
    z = (x - middle) / spread
    sign = z / np.maximum(np.sqrt((z * z).sum(1)), 1e-300)[:, None]
    found = []
    for c in (np.eye(outliers.P), np.tanh(z).T @ np.tanh(z) / n, sign.T @ sign / n):
        scale = np.sqrt(np.maximum(np.diag(c), 1e-9))
        now = outliers._estimate(middle, c / np.outer(scale, scale) * np.outer(spread, spread))
        for _ in range(outliers.FIRST_STEPS):
            now = step(*now[:2])
        found.append(now)
    best = min(found, key=lambda f: f[2])
    for _ in range(outliers.STEPS):
        after = step(*best[:2])
        if best[2] - after[2] <= outliers.TOLERANCE:
            return best
        best = after
    return best


def test_least_determinant(spark):
    r = np.random.default_rng(5)
    groups = {"few": np.concatenate([r.normal(0, 1, (11, 6)), r.normal(15, 1, (3, 6))]), "many": np.concatenate([r.normal(0, 1, (300, 6)) @ r.normal(0, 1, (6, 6)), r.normal(6, 0.2, (60, 6))]), "copies": np.repeat(r.normal(0, 1, (2, 6)), [50, 3], 0)}
    table = [(k, *map(float, x)) for k, rows in groups.items() for x in rows]
    got = {x["key"]: x for x in outliers.least_determinant(spark.createDataFrame(table, "key string, " + ", ".join(f"x{i} double" for i in range(6))).repartition(4)).collect()}
    for k, x in groups.items():
        want = plain_mcd(x)
        assert got[k]["n"] == len(x) and abs(got[k]["logdet"] - want[2]) < 1e-3 and np.allclose(got[k]["m"], want[0], atol=1e-3)
    x = groups["few"]  # every subset
    least = min(outliers._estimate(s.mean(0), outliers.CONSISTENCY * np.cov(s.T, bias=True))[2] for s in (x[list(i)] for i in combinations(range(14), 11)))
    assert abs(got["few"]["logdet"] - least) < 1e-6
    d = r.normal(0, 1, (200_000, 6))
    assert abs(outliers.chi_square(7.0, 6) - ((d**2).sum(1) <= 7).mean()) < 0.01


def test_verdicts_equal_plain_estimates(labelled, monkeypatch):
    monkeypatch.setattr(outliers, "LEAST", 200)  # of three sources one has too few rows, and goes by its language
    rows = [(x["doc_id"], x["text"], x["lang"], "s2" if x["doc_id"] % 9 == 0 else x["source"]) for x in labelled[0].collect()]
    got = {x["doc_id"]: x for x in outliers.quality_rules(labelled[0].sparkSession.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    c = {k: v.astype(float) for k, v in statistics.counts([x[1] for x in rows]).items()}
    chars, n = c["word_chars"] + 200, c["n_words"] + 30
    x = np.stack([np.log((c["word_chars"] + 180) / n), *(np.log1p(c[k] * 100 / chars) for k in ("n_symbols", "n_upper", "n_marks")), np.log1p(c["n_repeat_words"] * 100 / n), np.log1p(c["n_dup_lines"] * 10 / (c["n_lines"] + 3))], 1)
    failed = (c["n_words"] < 10) | (c["n_repeat_words"] * 100 > c["n_words"] * 20)
    source = np.array([r[3] for r in rows])
    assert (~failed & (source == "s2")).sum() < 200 < (~failed & (source == "s0")).sum()
    for s in ("s0", "s1", "s2"):
        m, w, _ = plain_mcd(x[~failed & ((source == s) | (s == "s2"))])
        factor = np.zeros((6, 6))
        factor[np.tril_indices(6)] = w
        d = (((x - m) @ factor.T) ** 2).sum(1)
        for i in np.flatnonzero(source == s):
            assert np.isclose(got[rows[i][0]]["distance"], d[i], rtol=1e-2, atol=1e-3) and got[rows[i][0]]["kept"] == (not failed[i] and d[i] <= outliers.CUTOFF)


def test_scores_are_of_plain_densities(labelled):
    df, labels = labelled
    y = {r["doc_id"]: r["quality"] for r in labels.where("quality is not null").collect()}
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    x, k = quality.features([t for _, t in rows]), np.array([y[i] if y.get(i) is not None and zlib.crc32(str(i).encode()) % 4 != 2 else -1 for i, _ in rows])
    z = [x[k == c] for c in (0, 1)]
    n = [len(a) for a in z]
    within = [np.cov(a.T, bias=True) for a in z]
    scale = np.sqrt(np.maximum(np.var(x[k >= 0], 0), 1e-6))
    pooled, logs = sum(a * c for a, c in zip(n, within)) / sum(n) / np.outer(scale, scale), []
    for a, c, m in zip(z, within, n):
        c = c / np.outer(scale, scale)
        c = (1 - quality.SHRINKAGE) * c + quality.SHRINKAGE * (pooled / 2 + np.eye(quality.FEATURES) * max(np.trace(c) / quality.FEATURES, 1e-3) / 2)
        off = (x - a.mean(0)) / scale
        logs.append(np.log(m) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(c), off))
    model = quality.fit(quality.described(df), labels)
    assert np.allclose(model.difference(x), logs[1] - logs[0], rtol=1e-6, atol=1e-6)
    got = {r["doc_id"]: r["score"] for r in quality.scored(quality.described(df), model).collect()}
    want = 1 / (1 + np.exp(-np.clip(model.slope * np.arcsinh(logs[1] - logs[0]) + model.intercept, -500, 500)))
    assert model.slope > 0 and np.allclose([got[i] for i, _ in rows], want, atol=1e-6)


def test_rows_without_ids_are_spread(spark, monkeypatch):
    table = spark.createDataFrame([(None if i % 3 else i, f"text {i // 2}") for i in range(300)], "doc_id long, text string")
    placed, _ = common.in_id_order(table, 8)
    parts = {r["part"]: r["n"] for r in placed.groupBy("part").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert sum(n for p, n in parts.items() if p < 0) == 200 and len([p for p in parts if p < 0]) > 2 and max(parts.values()) < 80
    got = fingerprints.fingerprint_versions(table).collect()
    assert len(got) == 300 and all((r["near_next"] == 1) == (r["next_differs_by"] == 0) for r in got)
    path = scratch(spark)
    wavelet.write_shards(table, tokenizer_path(BPE), path)
    read = sorted((r["start"], r["n_tokens"], r["doc_id"] or -1) for r in wavelet.read_documents(spark, path).collect())
    assert len(read) == 300 and all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(read, read[1:]))


def test_quality_on_held_out_rows(labelled):
    df, labels = labelled
    stats = quality.described(df)
    got = {r["doc_id"]: r for r in quality.scored(stats, quality.fit(stats, labels)).collect()}
    assert len(got) == 600
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    out = [(r["predicted"], int(i % 5 > 0)) for i, r in got.items() if r["held_out"]]
    assert sum(a == b for a, b in out) >= 0.98 * len(out)
    assert {r["doc_id"] for r in quality.keep_good(df, labels).collect()} == {i for i, r in got.items() if r["score"] >= 0.7}


def test_quality_of_awkward_rows(docs, empty, labelled):
    stats = quality.described(docs)
    got = quality.scored(stats, quality.fit(quality.described(labelled[0]), labelled[1])).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    nothing = quality.fit(quality.described(empty), labelled[1])
    assert nothing.means is None and quality.scored(quality.described(empty), nothing).collect() == []
    assert quality.keep_good(docs, labelled[1].limit(0)).count() == len(rows())


def test_outliers(labelled, docs, empty):
    got = {r["doc_id"]: r for r in outliers.quality_rules(labelled[0]).collect()}
    assert all(r["kept"] == (i % 5 > 0) for i, r in got.items())
    awkward = outliers.quality_rules(docs).collect()
    assert len(awkward) == len(rows())
    for r in awkward:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and (not r["base_failed"] or not r["kept"])
    assert outliers.quality_rules(empty).collect() == []
    kept = outliers.keep_regular(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in awkward)


# --- 8


def brute_url(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(r), v, r) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return (host, path, max(fits)[2], max(fits)[1]) if fits else (host, path, None, "allow")


def test_a_url_of_a_million_characters(spark):
    trie, began = urls.Trie([*urls.RULES, ("block", "example.org/a/" + "b" * 40)]), time.process_time()
    for path, rule in (("/es/" + "e" * 1_000_000, "example.org/es/"), ("/" + "a" * 1_000_000, "org/"), ("/a/" + "b" * 1_000_000, "example.org/a/" + "b" * 40), ("/" + "a/" * 500_000, "org/")):
        assert trie.best("x.example.org", path)[1] == rule
    assert trie.best("a." * 500_000 + "fr", "/") is None
    assert time.process_time() - began < 1
    table = spark.createDataFrame([(1, "http://" + "a." * 100_000 + "example.org/en/" + "1" * 900_000)], "page_id long, url string")
    for limit in (urls.BROADCAST_CHARS, 0):
        assert urls.judged(table, broadcast_chars=limit).select("rule", "verdict").collect() == [("example.org/en/1", "block")]


@pytest.mark.parametrize("limit", [urls.BROADCAST_CHARS, 0])
def test_urls(spark, limit):
    r = random.Random(4)
    table = [(i, r.choice(["http", "https", "x"]) + r.choice(["://", ":/", "://"]) + r.choice(["a.", "", "B."]) + r.choice(["Example.org", "example.com", "org", "com", "notorg", ""]) + r.choice(["", "/"]) + "".join(r.choice(["en/", "es/", "fr", "de/", "1", "/", "?q", "#h", "x/"]) for _ in range(r.randint(0, 4)))) for i in range(500)]
    table += [(900, None), (901, ""), (902, "://"), (903, "http://org/"), (903, "http://org/")]
    got = urls.judged(spark.createDataFrame(table, "page_id long, url string"), broadcast_chars=limit).collect()
    assert len(got) == len(table)
    want = dict(table)
    for x in got:
        assert (x["host"], x["path"], x["rule"], x["verdict"]) == brute_url(want[x["page_id"]], urls.RULES)
    assert urls.judged(spark.createDataFrame([], "page_id long, url string"), broadcast_chars=limit).collect() == []


# --- 10


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def message(*parts):
    import struct

    out = b""
    for number, v in parts:
        if isinstance(v, float):
            out += varint(number << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += varint(number << 3) + varint(v)
        else:
            v = v.encode() if isinstance(v, str) else v
            out += varint(number << 3 | 2) + varint(len(v)) + v
    return out


def unigram():
    """A small model written by hand: nothing is trained."""
    table = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]
    table += [(p, -1.0 - 0.37 * i - 0.0113 * (i * i % 7), 1) for i, p in enumerate(["▁", "▁the", "▁a", "th", "e", "t", "h", "a", "b", "c", "ab", "▁ab", "abc", "s", "▁s", "he", "▁th", "ca", "bc"])]
    body = b"".join(message((1, message((1, p), (2, s), (3, t)))) for p, s, t in table)
    return body + message((2, message((3, 1), (35, 1)))) + message((3, message((1, "identity"), (3, 1), (4, 1), (5, 1))))


def test_unigram_parity():
    import sentencepiece

    own, rebuilt = sentencepiece.SentencePieceProcessor(model_proto=unigram()), pieces.Pieces(pieces.read_model(unigram()))
    r = random.Random(6)
    texts = ["".join(r.choice("abcthes  é") for _ in range(r.randint(0, 25))) for _ in range(500)] + ["", " ", "the  abc ", "<s> the"]
    ids, n = rebuilt.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == own.encode(texts)
    assert [rebuilt.decode(x) for x in np.split(ids, np.cumsum(n)[:-1])] == [own.decode(x) for x in own.encode(texts)]
    assert rebuilt.decode_many(ids, n) == [own.decode(x) for x in own.encode(texts)]


def test_parity_is_false_where_ids_differ():
    """A processor of another model, which gives some units and texts other ids."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=unigram().replace("▁the".encode(), "▁tho".encode()))
    r = random.Random(8)
    texts = ["".join(r.choice("abcthes  é▁") for _ in range(r.randint(0, 25))) for _ in range(500)] + ["the", "a the", "", " "]
    ids, n, same = pieces.Pieces(pieces.read_model(unigram()), own).verified(texts)
    want = [x.tolist() == own.encode(t) for x, t in zip(np.split(ids, np.cumsum(n)[:-1]), texts)]
    assert same == want and not all(want) and any(want)
    assert all(pieces.Pieces(pieces.read_model(unigram()), sentencepiece.SentencePieceProcessor(model_proto=unigram())).verified(texts)[2])


def test_bpe_parity_of_awkward_rows(docs, empty):
    got = pieces.encoded(docs, tokenizer_path(SPM)).collect()
    assert len(got) == len(rows()) and all(r["parity"] and r["decoded_same"] for r in got)
    assert pieces.encoded(empty, tokenizer_path(SPM)).collect() == []


def test_ids_and_texts_are_columns(docs, empty):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(SPM))
    ids = pieces.encode(docs, tokenizer_path(SPM))
    assert ids.columns == [*docs.columns, "ids"]
    got = sorted((r["doc_id"] or 0, r["text"] or "", np.frombuffer(r["ids"], "<u4").tolist()) for r in ids.collect())
    assert got == sorted((r[0] or 0, r[1] or "", own.encode(r[1] or "")) for r in rows())
    texts = pieces.decode(ids.drop("text"), tokenizer_path(SPM))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in texts.collect()) == [(i, t) for i, t, _ in got]
    assert pieces.decode(pieces.encode(empty, tokenizer_path(SPM)), tokenizer_path(SPM)).collect() == []


def test_models_that_are_not_rebuilt():
    body = message((1, message((1, "x"), (2, 0.0), (3, 4))))
    with pytest.raises(ValueError, match="user-defined"):
        pieces.Pieces(pieces.read_model(body))
    with pytest.raises(ValueError, match="white space"):
        pieces.Pieces(pieces.read_model(message((1, message((1, "a▁b"), (2, 0.0), (3, 1))))))


# --- pipeline


def test_pipeline_of_awkward_rows(spark, docs, labelled, tmp_path):
    import corpus_pipeline

    for name, df in (("documents", docs), ("labels", labelled[1])):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    df = docs
    for name, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.saved(stage(spark, df, str(tmp_path)))
        assert name == "best_fit_packing" or df.columns == docs.columns
    assert df.count() > 0
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing = corpus_pipeline.saved(stage(spark, nothing, str(tmp_path)))
    assert nothing.count() == 0
