"""Operator 4 (native): personal data, and terms that give it away.

DataFrame expressions only. Four base kinds are found by patterns and checks. Around
every finding, its neighbouring words are counted over the corpus: pointwise mutual
information between a term and a protected value, as a share of the value's own
information, says how much of the value the term discloses. How often the term's texts
have the value is taken at its lower confidence bound, so that a value of a single text
is judged too, and one text is weaker evidence than many. Terms over ``GENERALISED``
become a label of their kind and terms over ``REMOVED`` go, wherever they stand.

Which terms those are is found in three passes whose shuffles hold no texts: terms near
findings; a count of texts for these, as a small map a term that adds up before the
shuffle; and the places of the few that may still pass. Maps of a fixed number of bits
leave out other words before anything is counted or moved.

Patterns are written so that each runs in one pass over any text: possessive runs,
and a run is entered at its start or where the last match ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import guarded, marked, marks, saved, table

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",  # chains of fewer digits can't pass
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of these has no finding of the kind.
NEEDS = {"email": "contains(text, '@')", "ip": r"text rlike '[0-9]\\.[0-9]'", "card": r"text rlike '[0-9][ -]?[0-9]'", "phone": "contains(text, '+')"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Words on either side of a finding that are counted, and the code points searched for them.
NEAR, REACH = 3, 80
#: Standard deviations by which the lower bound lies under what is counted. With a term and a value of one
#: text alone, the share passes GENERALISED from about 20 texts on; with another text of the term, from 6e8.
DOUBT = 0.4
#: A term all of whose texts have the value passes REMOVED from about 200 texts of the corpus on if it stands in
#: four, from 540 if in three, from 4,400 if in two, and from 3 million if in one.
GENERALISED, REMOVED = 0.95, 0.99
TERM = r"[\p{L}\p{M}]++"
_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_of(kind: str, pattern: str, text: str = "text") -> str:
    """SQL for the matches of a pattern (a SQL string) as kind, start, end (code points, end exclusive) and value.

    What splitting leaves between the matches gives their places.
    """
    return f"""aggregate(
        arrays_zip(regexp_extract_all({text}, {pattern}, 0), split({text}, {pattern}, -1)),
        named_struct('at', 0, 'out', cast(array() as {_SPANS})),
        (s, x) -> named_struct(
            'at', s.at + length(x.`1`) + coalesce(length(x.`0`), 0),
            'out', if(x.`0` is null, s.out, array_append(s.out, named_struct('kind', {kind}, 'start', s.at + length(x.`1`), 'end', s.at + length(x.`1`) + length(x.`0`), 'value', x.`0`)))),
        s -> s.out)"""


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _passes(kind: str) -> str:
    """SQL for the check of a match x."""
    if kind == "ip":
        return f"x.value rlike {_quoted(f'^{_BYTE}(?:[.]{_BYTE}){{3}}$')}"
    if kind == "card":
        doubled = "(d, i) -> if(i % 2 = 1, if(cast(d as int) > 4, 2 * cast(d as int) - 9, 2 * cast(d as int)), cast(d as int))"
        return f"length({_digits('x.value')}) between 16 and 19 and aggregate(transform(split(reverse({_digits('x.value')}), ''), {doubled}), 0, (a, b) -> a + b) % 10 = 0"
    if kind == "phone":
        return f"length({_digits('x.value')}) between 8 and 15"
    return "true"


def base_spans() -> dict[str, Column]:
    """The findings of each kind in a column ``text`` without nulls."""
    none = f"cast(array() as {_SPANS})"
    return {k: F.expr(f"case when {NEEDS[k]} then filter({spans_of(repr(k), _quoted(PATTERNS[k]))}, x -> {_passes(k)}) else {none} end") for k in KINDS}


def _listed(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def _words(text: str, last: bool) -> str:
    """SQL for the NEAR lower-case terms next to a finding in what stands before or after it."""
    words = f"regexp_extract_all(lower({text}), {_quoted(TERM)}, 0)"
    return f"reverse(slice(reverse({words}), 1, {NEAR}))" if last else f"slice({words}, 1, {NEAR})"


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with its text (null: empty), the base findings and two hashes that name the text."""
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumns({f"_{k}": c for k, c in base_spans().items()})
    return rows.withColumns({"_base": F.expr("concat(_email, _ip, _card, _phone)"), "_h": F.xxhash64("text"), "_g": F.hash("text")})


def _contexts(found: DataFrame) -> DataFrame:
    """(value, term, text) for the terms near each finding; a text counts once, however many copies it has.

    A term is cut at the reach's edge, so the reach holds more words than are taken. Found
    values aren't terms: what stands inside any finding of the text is blanked by its place.
    """
    x = found.where("size(_base) > 0").select("_h", "text", F.explode("_base").alias("x"))
    before = "substring(text, greatest(x.start - {0}, 0) + 1, least(x.start, {0}))".format(REACH)
    after = f"substring(text, x.end + 1, {REACH})"
    inside = r"[^\\s]*[@0-9][^\\s]*"
    near = F.expr(f"array_union({_words(f'regexp_replace({before}, {chr(39)}{inside}{chr(39)}, {chr(39)} {chr(39)})', True)}, {_words(f'regexp_replace({after}, {chr(39)}{inside}{chr(39)}, {chr(39)} {chr(39)})', False)})")
    return x.select("_h", F.concat_ws(":", "x.kind", F.xxhash64(F.lower("x.value"))).alias("value"), F.col("x.kind").alias("kind"), F.explode(near).alias("term")).distinct()


def _share(texts: int, n_term: str) -> Column:
    """The share of a value's information that a term discloses at least; falls as ``n_term``, the term's texts, grows.

    The Wilson bound of n_both among n_term stands for the probability of the value given the term.
    """
    n, p, z = F.col(n_term), F.col("n_both") / F.col(n_term), DOUBT
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.log(F.lit(float(texts)) * low / F.col("n_value")) / F.log((F.lit(float(texts)) + 1) / F.col("n_value"))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumns({"_h": F.xxhash64("text"), "_g": F.hash("text")})


def _words_among(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(_h, _g, term) of the words of all texts, once a row, but for most of those that aren't among ``terms``."""
    words = _named(docs).select("_h", "_g", F.explode(F.expr(f"array_distinct(regexp_extract_all(lower(text), {_quoted(TERM)}, 0))")).alias("term"))
    return words.where(marked(marks(terms.select(F.xxhash64("term").alias("v")), "v"), F.xxhash64("term")))


def disclosing(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(_h, _g, terms) for the texts in which disclosing terms stand, each with its kind and share of information.

    Counts are of different texts, over all of ``docs``. A term has at least the texts in which it is near some
    value, and at least as many as its texts' hashes fall into different ones of 64 places; a share that is too
    small with those is too small with all. Only terms that may pass are then counted exactly.
    """
    near = saved(_contexts(spans))
    total = spans.select("_h").distinct().count()
    values = near.groupBy("value").agg(F.count_distinct("_h").alias("n_value"))
    seen = near.select("term", "_h").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    both = near.groupBy("value", "kind", "term").agg(F.count("*").alias("n_both"))
    may = saved(both.join(values, "value").join(seen, "term").where(_share(total, "n_near") >= GENERALISED).select("value", "kind", "term", "n_both", "n_value", "n_near"))
    place = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_h").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    least = _words_among(docs, may).groupBy("term").agg(F.bit_count(F.bit_or(place)).alias("n_places"))
    may = saved(may.join(least, "term").withColumn("n_least", F.greatest("n_near", "n_places")).where(_share(total, "n_least") >= GENERALISED).drop("n_least", "n_places"))
    where = saved(_words_among(docs, may).join(may.select("term").distinct(), "term").distinct())
    told = may.join(where.groupBy("term").agg(F.count("*").alias("n_term")), "term").withColumn("share", _share(total, "n_term")).where(F.col("share") >= GENERALISED)
    told = told.groupBy("term").agg(F.max(F.struct("share", "kind")).alias("most")).select("term", "most.share", "most.kind")
    return saved(where.join(told, "term").groupBy("_h", "_g").agg(F.sort_array(F.collect_set(F.struct("term", "kind", "share"))).alias("terms")))


def _term_spans() -> Column:
    """Where a text's disclosing terms stand, outside the base findings; the value is what replaces them.

    All terms are looked for at once: a text may have several for each finding.
    """
    pattern = r"concat('(?iu)(?<![\\p{L}\\p{M}])(?:\\Q', array_join(terms.term, '\\E|\\Q'), '\\E)(?![\\p{L}\\p{M}])')"
    of = "coalesce(filter(terms, t -> t.term = lower(y.value))[0], terms[0])"
    label = f"transform(array({of}), t -> if(t.share >= {REMOVED}, '', concat('[', t.kind, ' term]')))[0]"
    found = f"transform({spans_of(repr('term'), pattern)}, y -> named_struct('kind', 'term', 'start', y.start, 'end', y.end, 'value', {label}))"
    free = f"filter({found}, y -> not exists(_base, b -> b.start < y.end and y.start < b.end))"
    return F.expr(f"case when size(terms) > 0 then {free} else cast(array() as {_SPANS}) end")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256 and spans of every row of ``docs`` (doc_id, text; other columns are ignored).

    A null text is empty. Repeated rows repeat and count once as evidence. No rows give none.
    """
    rows = with_spans(docs.select("doc_id", "text"))
    # With a finding the text is kept for its surroundings; without, only its name is.
    spans = saved(rows.withColumn("text", F.expr("if(size(_base) > 0, text, '')")))
    told = disclosing(docs, spans)
    # A text of each is taken before it meets its terms, however many copies it has.
    terms = _named(docs).where(marked(marks(told, "_h"), F.col("_h"))).groupBy("_h", "_g").agg(F.first("text").alias("text")).join(told, ["_h", "_g"])
    terms = terms.join(spans.select("_h", "_g", "_base").dropDuplicates(["_h", "_g"]), ["_h", "_g"]).select("_h", "_g", _term_spans().alias("_terms"))
    out = spans.drop("text").join(terms, ["_h", "_g"], "left")
    every = _listed(f"concat(_base, coalesce(_terms, cast(array() as {_SPANS})))")
    return out.select("doc_id", *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(_listed("_base"), 256).alias("base_sha256"), every.alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with every finding in ``text`` replaced: base kinds by their names, terms as their shares ask.

    Overlapping findings become one replacement, named after the first. Null texts stay null.
    """
    return guarded(docs, _replaced)


def _replaced(docs: DataFrame) -> DataFrame:
    spans = saved(with_spans(docs.select("text")).select("_h", "_g", "_base", F.expr("if(size(_base) > 0, text, '')").alias("text")))
    told = disclosing(docs, spans)
    rows = with_spans(docs.withColumn("_null", F.col("text").isNull())).join(told, ["_h", "_g"], "left")
    named = "transform(_base, b -> named_struct('kind', b.kind, 'start', b.start, 'end', b.end, 'value', concat('[', upper(b.kind), ']')))"
    rows = rows.withColumn("_all", F.when((F.size("_base") == 0) & F.col("terms").isNull(), F.expr(f"cast(array() as {_SPANS})")).otherwise(F.array_sort(F.concat(F.expr(named), _term_spans()), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(b["end"] - a["end"]))))
    built = """aggregate(_all, named_struct('at', 0, 'out', ''),
        (s, x) -> if(x.start >= s.at, named_struct('at', x.end, 'out', concat(s.out, substring(text, s.at + 1, x.start - s.at), x.value)), named_struct('at', greatest(s.at, x.end), 'out', s.out)),
        s -> concat(s.out, substring(text, s.at + 1)))"""
    text = F.when(F.col("_null"), F.lit(None)).when(F.size("_all") == 0, F.col("text")).otherwise(F.expr(built))
    return rows.withColumn("text", text)


def op4_information_theoretic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
