"""Operator 3: exact n-gram Jaccard self-join, size-aware, as groups of linked documents.

Texts with equal shingle sets are one class, joined once. Between classes:

* light sets (few shingles) list all their subsets of ``SUBSET`` shingles; two light sets
  that link share at least that many, so they meet in a list;
* heavy sets are found by scanning inverted lists of the first shingles of each set,
  rarest first: linked sets share one of them. Light sets near the boundary are listed
  too, for heavy partners.

The boundary is the size from which listing subsets costs more rows than scanning.
No set is written down, as it takes more room than its text: texts are cut into shingles
once to count them and once for the lists, and those of candidates when they are compared.

A group of near copies is never paired off. In turns, each list compares its members
with one of them, its pivot, which the lists of one group mostly share; what links becomes
one component, and lists whose other members are in different components get other
pivots, as long as comparing those one by one would cost more. What is left is compared one by
one. Sizes, places in the list and signatures (odd sketches) first have to allow a link.
So every pair of classes that may link is either compared or already connected. A list
of many members is joined in pieces where Spark finds its partition skewed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import guarded, marked, marks, remove, saved, scratch, steps, table, texts_of
from .components import components
from .words import STEP_BYTES, U, Words, mix

#: Two sets link when PERCENT[0] * intersection >= PERCENT[1] * union.
PERCENT = (100, 80)
#: Shingles that two different linked sets have in common at least (4 of 4 and 5).
SUBSET, LARGEST_LIGHT = 4, 12
#: Shingles counted as frequent, for the order only; and cells of the map of shared ones. Both are fixed sizes.
FREQUENT, CELLS = 100_000, 1 << 24
#: Windows that one count of repeated shingles spans.
BLOCK = 1_000_000
#: Turns in which lists with members in different components get pivots, at most; the pivots a list in later turns; and
#: pairs a member that are compared one by one without another turn.
TURNS, PIVOTS, FEW_PAIRS = 3, 3, 4


def first_shingles(n: int) -> int:
    """How many of n ordered shingles a linked set must share one of."""
    return n + (-n * PERCENT[1] // PERCENT[0]) + 1


def sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(place, sorted distinct shingles) of each text of a batch."""
    hashed, at = Words(texts_of(batch), lower=True).windows()
    for i in range(len(batch)):
        yield i, np.unique(hashed[at[i] : at[i + 1]])


def class_of(shingles: np.ndarray) -> int:
    return int((mix(shingles).sum(dtype=U) + U(len(shingles))).astype(np.int64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """An odd sketch: every shingle flips one of one to two bits a shingle. Common shingles cancel in the xor of
    two sketches, so they differ in at most as many bits as the sets differ in shingles, and mostly in nearly as many."""
    words = 1 << max(0, (len(shingles) - 1).bit_length() - 6)
    bits = np.bincount((shingles & U(words * 64 - 1)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def may_link() -> Column:
    """Whether the signatures sig1 and sig2 of sets of n1 and n2 shingles differ by no more than linked sets may.
    The sizes of linked sets differ so little that one fold brings their signatures to one length."""
    half = "zip_with(slice({0}, 1, cast(size({0}) / 2 as int)), slice({0}, cast(size({0}) / 2 as int) + 1, cast(size({0}) / 2 as int)), (p, q) -> p ^ q)"
    a, b = (f"if(size({x}) > size({y}), {half.format(x)}, {x})" for x, y in (("sig1", "sig2"), ("sig2", "sig1")))
    differ = F.expr(f"aggregate(zip_with({a}, {b}, (p, q) -> bit_count(p ^ q)), 0, (p, q) -> p + q)")
    return differ * (PERCENT[0] + PERCENT[1]) <= (F.col("n1") + F.col("n2")) * (PERCENT[0] - PERCENT[1])


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from steps([batch], chars=STEP_BYTES)


SURVEY = "doc_id long, key long, n long, sig array<long>, mark long, is_doc boolean"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a document (its class and set size, and the signature and the text's mark where the task meets the class
    for the first time in a while), and rows of shingles that repeat within a block."""
    seen: set[int] = set()
    held: list[np.ndarray] = []
    size, names = 0, [c.split()[0] for c in SURVEY.split(", ")]

    def repeated() -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate([np.empty(0, U), *held]), return_counts=True)
        tokens, n = tokens[n > 1], n[n > 1]
        k = len(n)
        return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(tokens.astype(np.int64)), pa.array(n.astype(np.int64)), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.int64()), pa.array(np.zeros(k, bool))], names)

    for batch in _small(batches):
        keys, sizes, signs, marks = [], [], [], []
        for (_, s), mark in zip(sets(batch), batch.column("mark").to_pylist()):
            c = class_of(s) if len(s) else None
            keys.append(c)
            sizes.append(len(s))
            first = bool(len(s)) and c not in seen
            signs.append(signature(s) if first else None)
            marks.append(mark if first else None)
            if first:
                seen.add(c)
                held.append(s)
                size += len(s)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signs, pa.list_(pa.int64())), pa.array(marks, pa.int64()), pa.array(np.ones(len(sizes), bool))], names)
        if size > BLOCK:
            yield repeated()
            seen, held, size = set(), [], 0
    yield repeated()


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(class, shingles) of the texts of each step, of a class where the task meets it for the first time in a while."""
    seen: set[int] = set()
    size = 0
    for batch in _small(batches):
        got = []
        for _, s in sets(batch):
            if len(s) and (c := class_of(s)) not in seen:
                seen.add(c)
                got.append((c, s))
                size += len(s)
        yield got
        if size > BLOCK:
            seen, size = set(), 0


def _listed(frequent, light: int):
    """Rows (token, class, size and place): the lists in which each class stands."""
    least_listed = -(-(light + 1) * PERCENT[1] // PERCENT[0])  # a light set that may link with a heavy one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = frequent.value
        for step in _classes(batches):
            tokens, classes, places = [], [], []
            for c, s in step:
                n = len(s)
                got = []
                if n > light or n >= least_listed:
                    at = np.minimum(np.searchsorted(hot, s), max(len(hot) - 1, 0))
                    often = np.where(hot[at] == s, rank[at], 0) if len(hot) else np.zeros(n, np.int64)
                    if often.any():
                        s = s[np.argsort(often, kind="stable")]
                    got.append((s[: first_shingles(n)], np.arange(first_shingles(n))))
                if SUBSET <= n <= light:
                    subsets = np.array(list(combinations(np.sort(s), SUBSET)), U)
                    got.append((mix(mix(subsets).sum(1, dtype=U) + U(SUBSET)), np.zeros(len(subsets), np.int64)))
                for t, place in got:
                    tokens.append(t)
                    places.append((n << 32) + place)
                    classes.append(np.full(len(t), c, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).astype(np.int64)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(places).astype(np.int64))], ["token", "class", "size_place"])

    return run


LISTED = "token long, class long, size_place long"


def boundary(sizes: dict[int, int], scanned: float) -> int:
    """The largest light size: up to it, listing subsets makes no more rows than lists would scan.

    ``scanned`` is the expected number of other sets in a list.
    """
    light = SUBSET - 1
    while light < LARGEST_LIGHT and comb(light + 1, SUBSET) <= first_shingles(light + 1) * (1 + scanned):
        light += 1
    return light if any(sizes.get(s) for s in range(SUBSET, light + 1)) else SUBSET - 1


def cell_map(df: DataFrame, column: str):
    """A broadcast map of CELLS bits, those of the column's low bits set: what isn't in it can be left out
    before a shuffle. Its size is fixed; where there are many values it leaves out less."""
    bits = np.zeros(CELLS // 64, np.uint64)
    cell = f"({column} & {CELLS - 1}L)"
    for r in df.groupBy(F.expr(f"shiftright({cell}, 6)").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({cell} & 63 as int)))").alias("b")).collect():
        bits[r["w"]] = np.int64(r["b"]).astype(np.uint64)
    return df.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def in_map(cells: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.astype(np.int64) & (CELLS - 1)
    return (cells[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, shingles) of the classes of ``wanted`` (class, mark), once each, from the texts that have their marks.
    A few other classes may come along, which no join asks for; only these texts are cut and these sets shuffled."""
    cells = cell_map(wanted, "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in _classes(batches):
            asked = in_map(cells.value, np.array([c for c, _ in step], np.int64))
            got = [x for x, ask in zip(step, asked) if ask]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in got], pa.int64()), pa.array([s.view(np.int64) for _, s in got], pa.list_(pa.int64()))], ["class", "shingles"])

    return texts.where(marked(marks(wanted, "mark"), F.col("mark"))).select("text").mapInArrow(run, "class long, shingles array<long>").groupBy("class").agg(F.first("shingles").alias("shingles"))


def linked(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets link."""
    both = pairs.join(shingles.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a").join(shingles.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("n"))
    return common.where(F.col("i") * (PERCENT[0] + PERCENT[1]) >= F.col("n") * PERCENT[1]).select("a", "b")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, class (of equal sets), n, name (of the component: its least class) and component_id (its least
    doc_id, if any row of it has one) for every row of ``docs``; without shingles the last four are null, 0, null, null.
    ``docs`` is read several times, and must give the same rows each time."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    paths: list[str] = []  # of tables that go when the result is written down

    def kept(df: DataFrame) -> DataFrame:
        paths.append(scratch(spark))
        return saved(df, paths[-1])

    texts = docs.select("text", F.xxhash64("text").alias("mark"))
    survey = kept(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark")).mapInArrow(_survey, SURVEY))
    documents = survey.where("is_doc").select("doc_id", F.col("key").alias("class"), "n")

    often = survey.where("not is_doc").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(FREQUENT).collect()  # a fixed number
    hot = np.array([r["key"] for r in often], np.int64).astype(U)
    count = np.array([r["n"] for r in often], np.int64)
    order = np.argsort(hot)
    frequent = sc.broadcast((hot[order], count[order]))
    total = documents.agg(F.sum("n")).first()[0] or 0
    small = {r["n"]: r["count"] for r in documents.where(F.col("n") <= LARGEST_LIGHT).groupBy("n").count().collect()}
    light = boundary(small, float((count.astype(float) ** 2).sum() / max(total, 1)))

    # Postings are shuffled once, by token. A class that several tasks met stands in its lists several times until here.
    postings = texts.select("text").mapInArrow(_listed(frequent, light), LISTED)
    of_token = Window.partitionBy("token")
    shared = postings.select("*", F.min("class").over(of_token).alias("pivot"), F.max("class").over(of_token).alias("last")).where("pivot < last")
    members = kept(shared.select("token", "pivot", "class", F.shiftright("size_place", 32).alias("n"), F.col("size_place").bitwiseAND(0xFFFFFFFF).alias("place")).distinct())
    signs = kept(survey.where("sig is not null").groupBy(F.col("key").alias("class")).agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("mark").alias("mark")))

    # Sizes and places in a list bound what two sets can have in common; the list of their first common shingle lets linked ones pass.
    may = (F.least("n1", "n2") * PERCENT[0] >= F.greatest("n1", "n2") * PERCENT[1]) & (F.least(F.col("n1") - F.col("place1"), F.col("n2") - F.col("place2")) * (PERCENT[0] + PERCENT[1]) >= (F.col("n1") + F.col("n2")) * PERCENT[1])
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]

    def signed(pairs: DataFrame, one: str, other: str) -> DataFrame:
        """Those of different pairs of classes whose signatures allow a link."""
        for k, column in ((1, one), (2, other)):
            pairs = pairs.join(signs.select(F.col("class").alias(column), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"sig{k}")), column)
        return pairs.where(may_link())

    names = None

    def named(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.join(names.select(F.col("node").alias(column), F.col("component").alias(name)), column, "left").withColumn(name, F.coalesce(name, column)) if names is not None else df.withColumn(name, F.col(column))

    def link(candidates: DataFrame) -> None:
        nonlocal names
        candidates = kept(candidates)
        wanted = kept(candidates.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(signs.select("class", "mark"), "class"))
        shingles = saved(sets_of(texts, wanted), path := scratch(spark))
        edges = kept(linked(candidates, shingles).distinct())
        remove(spark, path)
        names = kept(components(edges if names is None else edges.union(names.where("node <> component").select("component", "node"))))

    turn, rows = 0, members.withColumn("name", F.col("class")).withColumn("pivots", F.array("pivot"))
    while True:
        leads = F.array_contains("pivots", F.col("class"))
        pivots = rows.where(leads).select("token", F.col("class").alias("pivot"), F.col("name").alias("other"), F.col("n").alias("n2"), F.col("place").alias("place2"))
        met = rows.select("token", "class", "name", F.col("n").alias("n1"), F.col("place").alias("place1")).join(pivots, "token").where((F.col("name") != F.col("other")) & may)
        link(signed(met.select(F.col("class").alias("x"), F.col("pivot").alias("y")).select(*pair).distinct(), "a", "b").select("a", "b"))
        # The others of one list that are still apart get other pivots; a list of two has only one.
        turn, rows = turn + 1, named(rows.where(~leads).select("token", "class", "n", "place"), "class", "name")
        salts = [F.xxhash64(F.lit(turn), F.lit(k)) for k in range(PIVOTS)]
        lists = rows.groupBy("token").agg(F.min("name").alias("low"), F.max("name").alias("high"), F.count("*").alias("m"), *(F.min(F.col("class").bitwiseXOR(x)).alias(f"p{k}") for k, x in enumerate(salts))).where("low < high")
        rows = kept(rows.join(lists.select("token", "m", F.array(*(F.col(f"p{k}").bitwiseXOR(x) for k, x in enumerate(salts))).alias("pivots")), "token"))
        n, n_pairs = rows.agg(F.count("*"), F.coalesce(F.sum((F.col("m") - 1) / 2), F.lit(0.0))).first()
        if turn == TURNS or n_pairs <= FEW_PAIRS * n:
            break

    if n:
        per_list = rows.groupBy("token", "name").count().groupBy("token").agg(F.max(F.struct("count", "name")).alias("most")).select("token", F.col("most.name").alias("most"))
        mixed = kept(rows.drop("pivots", "m").join(per_list, "token").join(signs.select("class", "sig"), "class"))
        columns = ("class", "n", "place", "name", "sig")
        one = mixed.where("name <> most").select("token", "most", *(F.col(c).alias(f"{c}1") for c in columns))
        other = mixed.select("token", *(F.col(c).alias(f"{c}2") for c in columns))
        crossing = (F.col("name1") != F.col("name2")) & ((F.col("name2") == F.col("most")) | (F.col("class1") < F.col("class2")))
        met = one.alias("p").join(other.alias("q"), (F.col("p.token") == F.col("q.token")) & crossing & may & may_link())
        link(met.select(F.col("class1").alias("x"), F.col("class2").alias("y")).select(*pair).distinct())

    of_class = documents.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first_id"))
    by_name = named(of_class, "class", "name")
    by_name = by_name.join(by_name.groupBy("name").agg(F.min("first_id").alias("component_id")), "name").select("class", "name", "component_id")
    out = saved(documents.join(by_name, "class", "left").select("doc_id", "class", "n", "name", "component_id"))
    remove(spark, *paths)
    return out


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) for every row of ``docs``.

    Other columns are ignored. Null or empty texts, and texts of white space, have no
    shingles and link with nothing; rows without doc_id take part in links and have
    their component's least known doc_id, or null. Repeated rows give repeated rows. No rows give none.
    """
    return grouped(docs).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _with_class(docs: DataFrame) -> DataFrame:
    """``docs`` with _class, the class of its text (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            classes = [class_of(s) if len(s) else None for _, s in sets(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(classes, pa.int64())], [*batch.schema.names, "_class"])

    return docs.mapInArrow(run, docs.withColumn("_class", F.lit(None).cast("long")).schema)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group: of its least doc_id, or any one where no row of the group has a doc_id.

    Rows without words link with nothing and stay. A doc_id that several rows have, or none, tells no
    rows apart; there the text's class says which row is meant.
    """
    return guarded(docs, _one_of_each)


def _one_of_each(docs: DataFrame) -> DataFrame:
    groups = grouped(docs)
    best = groups.where("class is not null").groupBy("name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "class")).alias("best"))
    stay = groups.where("class is null").select("doc_id", "class").union(best.select("best.doc_id", "best.class"))
    unclear = groups.groupBy("doc_id").agg(F.count("*").alias("rows")).where("doc_id is null or rows > 1").select(F.col("doc_id").alias("_id"))
    if not unclear.head(1):
        return docs.join(stay.select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    unclear, stay = saved(unclear), saved(stay)
    clear = docs.join(unclear, docs["doc_id"].eqNullSafe(unclear["_id"]), "left_anti").join(stay.select("doc_id"), "doc_id", "left_semi")
    named = _with_class(docs.join(unclear, docs["doc_id"].eqNullSafe(unclear["_id"]), "left_semi"))
    meant = stay.select(F.col("doc_id").alias("_id"), F.col("class").alias("_c")).distinct()
    found = named.where("_class is null").drop("_class").union(
        named.where("_class is not null").join(meant, named["doc_id"].eqNullSafe(meant["_id"]) & (F.col("_class") == F.col("_c")), "left_semi").dropDuplicates(["doc_id", "_class"]).drop("_class")
    )
    return clear.select(docs.columns).union(found.select(docs.columns))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))
