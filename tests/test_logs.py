"""Functions and operators of the log library on small tables with known answers."""

import datetime as dt
import itertools
import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sawmill.functions import levels, paths, patterns, text
from sawmill.functions import predicates as p
from sawmill.operators import aggregate, columns, facets, retrieve
from sawmill.operators.normalize import is_json_log, normalize
from sawmill.plans import checks
from sawmill.sources import files, growing, retention
from sawmill.streaming import live

NOW = dt.datetime(2026, 5, 26, 12, 0, 0)


def lines_of(spark, lines, source="s"):
    rows = [(i, source, x if isinstance(x, str) or x is None else json.dumps(x), NOW) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "seq long, source string, line string, ingest_ts timestamp")


def entries_of(spark, lines):
    return normalize(lines_of(spark, lines))


#: Parcels on their way: level, service, message, time and what else a line has.
PARCELS = [
    {"level": "trace", "service": "belt/east", "msg": "parcel 17 weighed", "ts": 40, "parcel": {"grams": 950, "fragile": False}},
    {"level": "notice", "service": "belt/west", "msg": "parcel 18 weighed", "ts": 50, "parcel": {"grams": "1200"}, "crew": "night"},
    {"level": "fatal", "service": "gate", "msg": "Gate 3: arm stuck", "ts": 60.5, "crew": "night"},
    {"level": "warn", "service": "gate", "msg": "50% of arms are slow", "ts": 70, "crew": ""},
    {"level": "info", "service": "desk", "msg": "", "ts": 80, "parcel": {"grams": "heavy"}},
]


@pytest.fixture(scope="module")
def parcels(spark):
    return entries_of(spark, PARCELS).cache()


PREDICATES = [
    (lambda: p.eq("service", "gate"), 2), (lambda: p.eq("service", "Gate"), 0), (lambda: p.eq("parcel.fragile", "false"), 1), (lambda: p.eq("parcel.grams", "1200"), 1),
    (lambda: p.eq("crew", ""), 3), (lambda: ~p.eq("crew", "night"), 3), (lambda: p.eq("parcel", ""), 5),
    (lambda: p.contains("msg", "weighed"), 2), (lambda: p.contains("service", "belt/"), 2), (lambda: p.contains("crew", "i"), 2), (lambda: p.msg_contains("%"), 1), (lambda: p.msg_eq("parcel 17 weighed"), 1), (lambda: p.msg_eq(""), 1),
    (lambda: p.glob("service", "belt/*"), 2), (lambda: p.glob("msg", "*arm*stuck"), 1), (lambda: p.glob("msg", "*arm"), 0), (lambda: p.glob("msg", "50%*"), 1), (lambda: p.glob("crew", "*"), 5), (lambda: p.glob("msg", r"*\**"), 0),
    (lambda: p.exists("crew"), 2), (lambda: p.exists("parcel.grams"), 3), (lambda: ~p.exists("msg"), 1),
    (lambda: p.num_between("ts", 50, 70), 3), (lambda: p.num_between("parcel.grams", 900, 1200), 2), (lambda: p.num_cmp("parcel.grams", ">", 950), 1), (lambda: ~p.num_cmp("parcel.grams", "<=", 950), 4),
    (lambda: p.str_cmp("service", "<", "desk"), 2), (lambda: p.str_cmp("crew", "<", "a"), 3), (lambda: p.str_cmp("crew", ">=", "n"), 2),
    (lambda: p.level_cmp(">=", "warn"), 2), (lambda: p.level_cmp("<", "info"), 1), (lambda: p.level_cmp(">", "odd"), 0), (lambda: p.level_cmp("<=", "fatal"), 4),
    (lambda: p.regex("msg", "^parcel 1[78]"), 2), (lambda: p.regex("msg", "GATE", "i"), 1), (lambda: p.regex("msg", "GATE"), 0), (lambda: p.regex("crew", "^$"), 3),
    (lambda: (p.eq("service", "gate") | p.eq("service", "desk")) & ~p.level_cmp(">=", "warn"), 1), (lambda: ~(p.exists("crew") | p.exists("parcel.grams")), 1), (p.match_all, 5),
    (lambda: p.time_window(50, 70), 2), (lambda: p.time_window(0, 60), 2), (lambda: p.time_brush(60.9, 69.2), 2),
]


def test_predicates(parcels):
    got = parcels.agg(*(F.count_if(w()).alias(f"c{i}") for i, (w, _) in enumerate(PREDICATES))).first()
    assert list(got) == [n for _, n in PREDICATES]
    nulls = parcels.agg(*(F.count_if(w().isNull()).alias(f"c{i}") for i, (w, _) in enumerate(PREDICATES))).first()
    assert not any(nulls)


def test_bad_patterns_are_refused():
    for pattern, flags in (("[", ""), ("a", "g"), ("(?=a)", ""), (r"(a)\1", "")):
        with pytest.raises(Exception):  # noqa: B017
            p.regex("msg", pattern, flags)


EXPONENTIAL = [
    r"^(a+)+$", r"(a*)*b", r"^(a|a)*$", r"^(a|aa)+$", r"^(\w|\d)+$", r"^(a|[ab])*$", r"(a|b|a)*!", r"(a?b?)*c", r"((x?|y?)a)*!", r"((a*)?b)*!", r"(x(a?)*y)*!", r"^([a-z]+\s*)+$", r"^(.*)*$", r"(\d+,?)+;",
    r"([^,]*,?)*;", r"(\w+\s?){1,50}:", r"^(([a-z])+.)+[A-Z]([a-z])+$", r"(?i)^(a|A)*$", r"^(?:a|b|ab)*c", r"(?s)^(.|\n)*x", r"(\[|[\[|])*x",
]
PLAIN = [
    "", "^$", "error|warn", r"^parcel 1[78]", r"\d{1,3}(\.\d{1,3}){3}", r"^(\w+\s)+$", r"(foo|foobar)*$", r"[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}", ".*error.*timeout.*", "a*a*b", r"(GET|POST|PUT) /(\w+/)*\w*$",
    r'"([^"\\]|\\.)*"$', r"^(?:[a-z]+\.)+com$", r"\[|\]|(?P<x>a|b)+$", "(?s)^(.)*x", "(ab|cd)*ef", r"(\w+\s?){3}:", "x{1000}", r"^(.|\n)*x", "^(a|A)*$", "(a+)+", "^(a+)+",
]


def test_patterns_of_exponential_time_are_refused():
    assert [x for x in EXPONENTIAL if not patterns.exponential(x)] == []
    assert [x for x in PLAIN if patterns.exponential(x)] == []
    assert patterns.exponential("^(a|A)*$", ignore_case=True)
    for pattern, flags in ((r"^(a+)+$", ""), ("^(a|A)*$", "i"), ("a++", ""), ("(?>a)", "")):
        with pytest.raises(ValueError):
            p.regex("msg", pattern, flags)


def _ways(items, text, at, tried):
    """Places after a row of a pattern's items, each with the ways to it from the places ``at``; counts every character tried on the way."""
    for kind, arg in items:
        if kind is patterns.op.LITERAL:
            tried[0] += sum(at.values())
            at = Counter({b + 1: n for b, n in at.items() if text[b : b + 1] == chr(arg)})
        elif kind is patterns.op.SUBPATTERN:
            at = _ways(arg[3], text, at, tried)
        elif kind is patterns.op.BRANCH:
            at = sum((_ways(x, text, at, tried) for x in arg[1]), Counter())
        else:
            done, todo = Counter() if arg[0] else Counter(at), Counter(at)
            while todo:
                b = min(todo)
                n, inner = todo.pop(b), [0]
                for e, m in _ways(arg[2], text, Counter({b: 1}), inner).items():
                    done[e] += n * m
                    if e > b:  # a turn that reads nothing is the last
                        todo[e] += n * m
                tried[0] += n * inner[0]
            at = done
    return at


def test_patterns_against_counted_ways():
    draw = random.Random(11)

    def made(depth):
        if depth == 0:
            return draw.choice("ab")
        x, y = made(depth - 1), made(draw.randrange(depth))
        return draw.choice([f"{x}{y}", f"({x}|(){y})", f"({x})*", f"({x})+", f"{x}{y}"])

    texts = [h + "".join(w) * 32 for h in ("", "a", "b", "ab", "ba") for n in (1, 2, 3, 4) for w in itertools.product("ab", repeat=n)]
    seen = Counter()
    for _ in range(40):
        pattern = f"({made(2)})*!"
        growth = 0
        for x in texts:
            short, long = [0], [0]
            _ways(patterns._parser.parse(pattern)[:-1], x[:16], Counter({0: 1}), short)
            _ways(patterns._parser.parse(pattern)[:-1], x[:32], Counter({0: 1}), long)
            growth = max(growth, long[0] / max(1, short[0]))
        # Twice the text: a power of it is at most 8 times the work for patterns as small as these.
        assert patterns.exponential(pattern) == (growth > 12), (pattern, growth)
        seen[growth > 12] += 1
    assert min(seen.values()) > 5


def test_dots_and_punctuation(spark):
    df = entries_of(spark, [{"msg": "belt (7) <halted>", "code": "BELT.STOP/7", "w.x": 1, "w": {"y": 2.0}}, {"msg": "gate ==> yard", "code": "OK"}, {"msg": "load is 90%", "n": 1e3, "t": True, "z": None}])
    want = [(p.eq("code", "BELT.STOP/7"), 1), (p.msg_contains("(7) <"), 1), (p.msg_contains("==>"), 1), (~p.msg_contains("load"), 2), (p.eq("w.x", "1"), 1), (p.eq("w.y", "2"), 1), (p.eq("n", "1000"), 1), (p.eq("t", "true"), 1), (p.exists("z"), 0), (p.glob("msg", "*90%*"), 1), (p.glob("msg", "*90_*"), 0)]
    assert list(df.agg(*(F.count_if(c).alias(f"c{i}") for i, (c, _) in enumerate(want))).first()) == [n for _, n in want]


def test_predicates_on_columns_reach_the_scan(spark, parcels, tmp_path):
    files.write_table(parcels.drop("fields"), f"file://{tmp_path}/t")
    t = files.read_table(spark, f"file://{tmp_path}/t")
    plan = checks.pushed_filters(t.where(p.eq("service", "gate") & ~p.eq("level", "info") & p.time_window(1, 4)).select("seq"))
    assert "EqualNullSafe(service,gate)" in plan and "GreaterThanOrEqual(ts,1.0)" in plan and "level" in plan
    assert not checks.runs_python(t)


def test_text_lines(spark):
    at = lambda *a, us=0: dt.datetime(*a, us, tzinfo=dt.timezone.utc).timestamp()
    cases = [
        ("07:30:05 the kiln is WARNING hot", "warn", at(2024, 1, 1, 7, 30, 5)), ("kiln 07:30:05.125 DEBG lid shut", "debug", at(2024, 1, 1, 7, 30, 5, us=125_000)),
        ("2031-02-03 04:05:06,5 (kiln) ERRO lid open", "error", at(2031, 2, 3, 4, 5, 6, us=500_000)), ("<2031-02-03T04:05:06.000007Z> [ notice ] lid", "notice", at(2031, 2, 3, 4, 5, 6, us=7)),
        ("2031-02-03T04:05:06-0330 CRIT x", "fatal", at(2031, 2, 3, 7, 35, 6)), ("2031-02-03T04:05:06+02:00 [lid] [E] x", "error", at(2031, 2, 3, 2, 5, 6)),
        ("at 2031-02-30 04:05:06 then 07:30:05", None, None), ("123:45:67 12:3:4 no times", None, None), ("[verbose][fatal] the first counts", "trace", None), ("LID shut, then FINE", "debug", None), ("an error in small letters", None, None),
        ("INFORMATION and INFO", "info", None), ("XINFO INFOX INf", None, None), ("", None, None), ("." * 90 + " ERROR", "error", None), ("." * 96 + " ERROR 07:30:05", None, None),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, *_) in enumerate(cases)], "i int, line string")
    got = df.select(text.text_level(F.col("line")), text.text_time(F.col("line"), "2024-01-01")).collect()
    for (line, level, when), g in zip(cases, got):
        assert g[0] == level, line
        assert (g[1] is None) == (when is None) and (when is None or abs(g[1] - when) < 1e-5), line
    today = df.select(text.text_time(F.col("line")), F.unix_timestamp(F.current_date().cast("timestamp")), "line").where("i < 3").orderBy("i").collect()
    assert [r[0] for r in today] == [today[0][1] + 27005, today[1][1] + 27005.125, cases[2][2]]


def test_ansi(spark):
    cases = {"\x1b[31mred\x1b[0m": "red", "\x1b]0;t\x07x": "x", "\x1b]0;a\x1bb\x1b\\x": "x", "a\x1b[12": "a", "a\x1bMb": "a\x1bMb"}
    df = spark.createDataFrame(list(cases.items()), "a string, b string")
    assert df.where(text.strip_ansi(F.col("a")) != F.col("b")).count() == 0


def test_levels(spark):
    words = {"INFO": "info", "Info": "info", "DEBG": "debug", "FINE": "debug", "WARNING": "warn", "ERRO": "error", "SEVERE": "error", "critical": "fatal", "panic": "fatal", "verbose": "trace", " notice ": "notice", "": None, "random": None}
    numbers = dict(zip([10, 20, 30, 40, 50, 60, 100, 200, 250, 300, 400, 500, 550, 600, 5000, 10000, 20000, 30000, 40000, 0, 3, 4, 6, 7, 8, -1], "trace debug info warn error fatal debug info notice warn error fatal fatal fatal trace debug info warn error fatal error warn info debug None None".split()))
    got = spark.createDataFrame([(k,) for k in words], "k string").select("k", levels.normalize_level(F.col("k"))).collect()
    assert {r[0]: r[1] for r in got} == words
    got = spark.createDataFrame([(float(k),) for k in numbers], "k double").select("k", levels.normalize_level_num(F.col("k"))).collect()
    assert {int(r[0]): str(r[1]) for r in got} == numbers
    objects = [({"level": 400, "level_name": "ERROR"}, "error"), ({"log.level": "INFO"}, "info"), ({"record": {"level": {"name": "DEBUG", "no": 10}}}, "debug"), ({"record": {"level": "WARNING"}}, "warn"), ({"level": {"no": 40}}, "warn"), ({"level": "odd", "msg": "x"}, "odd")]
    assert [r["level"] for r in entries_of(spark, [o for o, _ in objects]).orderBy("seq").collect()] == [x for _, x in objects]


def test_normalize_routes_lines(spark):
    got = entries_of(spark, ["Traceback", "  at line", {"level": "debug", "ts": 1801234567.125, "service": "yard", "msg": "crane up"}, "{bad json", '{"foo": 1}', '{"level":"a","level":"ERROR","msg":"twice"}', None, "\x1b[31mERROR x\x1b[0m", {"timestamp": "2026-05-26T00:00:00Z", "message": "m", "logger": "l"}]).orderBy("seq").collect()
    assert [r["is_text"] for r in got] == [True, True, False, True, True, False, True, True, False]
    assert got[2]["ts"] == 1801234567.125 and got[2]["level"] == "debug" and got[5]["level"] == "error"
    assert got[7]["msg"] == "ERROR x" and got[7]["ansi"].startswith("\x1b") and got[7]["level"] == "error" and got[0]["ansi"] is None
    assert got[8]["msg"] == "m" and got[8]["caller"] == "l" and got[8]["event_ts"] == dt.datetime(2026, 5, 26)
    strict = is_json_log(lines_of(spark, [{"record": {"message": "x"}}, {"msg": 1}]), strict=True).orderBy("seq").collect()
    assert [r["is_json"] for r in strict] == [False, True]


def test_histogram(spark):
    rows = [(200.0, "FATAL"), (229.9, "panic"), (230.0, "notice"), (259.9999, "trace"), (260.0, "debug"), (289.0, None), (290.0, "warn"), (199.9, "error"), (320.0, "error"), (319.5, "odd")]
    df = spark.createDataFrame(rows, "ts double, level string")
    got = [tuple(r) for r in aggregate.histogram(df, 200, 320, 30).select("bucket", "t", *aggregate.CLASS_NAMES).orderBy("bucket").collect()]
    assert got == [(0, 200.0, 2, 0, 0, 0, 0), (1, 230.0, 0, 0, 1, 1, 0), (2, 260.0, 0, 0, 0, 1, 1), (3, 290.0, 0, 1, 0, 0, 1)]
    assert [tuple(r)[1:6] for r in aggregate.histogram(df, 900, 960, 30).collect()] == [(0,) * 5] * 2
    assert aggregate.histogram(df, 200, 290.5, 30).count() == 4  # the last, shorter bucket too
    for bad in ((200, 320, 0), (320, 200, 30), (0, 50_001, 10)):
        with pytest.raises(ValueError):
            aggregate.histogram(df, *bad)
    assert [aggregate.auto_bucket(s) for s in (0, 36_000, 100_000, 10**7)] == [60, 300, 840, 3600]


def test_retrieval(spark):
    df = spark.range(500).select(F.col("id").alias("seq"), (F.col("id") * 5 + 1778236500).cast("double").alias("ts"), F.lit("info").alias("level"))
    assert [r["seq"] for r in retrieve.search(df, p.num_between("ts", 1778236500, 1778237000), limit=300).collect()] == list(range(101))
    assert [r["seq"] for r in retrieve.tail_recent(df, 300, p.eq("level", "info")).collect()] == list(range(200, 500))
    page = retrieve.page_before(df, 30, limit=10).collect()
    assert [r["seq"] for r in page] == list(range(20, 30)) and not page[0]["is_end"] and retrieve.page_before(df, 5, limit=10).first()["is_end"]
    assert retrieve.get_entry(df, 7).count() == 1 and [r["seq"] for r in retrieve.newest_first(df.union(df), 2).collect()] == [499, 498]
    assert aggregate.retain_last(spark.range(24).select(F.col("id").alias("seq")), 8).agg(F.min("seq"), F.max("seq")).first()[:] == (16, 23)
    gaps = aggregate.detect_gaps(spark.createDataFrame([("a", s) for s in (1, 2, 5, 2_000_000)] + [("b", 9)], "source string, seq long"))
    assert sorted(tuple(r) for r in gaps.collect()) == [("a", 2, 5, 2), ("a", 5, 2_000_000, 1_999_994)]


def test_diff(spark):
    df = entries_of(spark, [{"msg": "a", "x": {"y": 1, "z": [1, 2]}}, {"msg": "a", "x": {"y": 2}, "w": "new"}])
    got = retrieve.diff_rows(df, spark.createDataFrame([(0, 1)], "left long, right long")).collect()
    assert {(r["path"], r["left_value"], r["right_value"]) for r in got} == {("x.y", "1", "2"), ("x.z", "[1,2]", ""), ("w", "", "new")}


def test_exact_facets_scan_the_table_once_more_for_what_the_summary_leaves_open(spark, tmp_path):
    entries_of(spark, [{"ts": i, "msg": "same"} for i in range(60)]).select("fields", "service", "level").write.parquet(f"{tmp_path}/table")
    summary = spark.createDataFrame([("msg", "same", 60, 60, 1), ("ts", None, None, 60, 1)], "path string, value string, n long, total long, unsure long")
    found = live.exact_top_facets(spark.read.parquet(f"{tmp_path}/table"), summary, top=2)
    assert sum("Relation" in line and "fields#" in line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines()) == 1
    assert sorted(map(tuple, found.collect())) == [("msg", "same", 60, 1), ("ts", "0", 1, 1), ("ts", "1", 1, 2)]


@pytest.mark.parametrize("size", [5, 40, 1_000])
def test_runs_are_joined_across_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(live, "RANGE", size)
    rnd = random.Random(size)
    rows = [(source, a, a + rnd.choice([0, 0, 1, 3, 60]), 1, 0) for source in ("a", "b", None) for a in rnd.sample(range(-50, 600), 90)]
    df = spark.createDataFrame(rows, "source string, first long, last long, seen long, batch long").withColumn("seen", F.timestamp_seconds("seen"))
    want = []
    for source in ("a", "b", None):
        runs: list[list] = []
        for _, first, last, *_ in sorted((r for r in rows if r[0] == source), key=lambda r: r[1:3]):
            if runs and first <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], last)
            else:
                runs.append([first, last, runs[-1][1] if runs else None])
        want += [(source, *r) for r in runs]
    found = live._joined_runs(df)
    assert sorted(map(tuple, found.select("source", "first", "last", "after").collect()), key=repr) == sorted(want, key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Window" in line and "last" in line and "_range" not in line]


def test_a_text_is_computed_once_however_often_it_is_used(spark):
    tall = spark.range(1).select(F.try_parse_json(F.lit("{}")).alias("fields")).select(paths.path_text("a").alias("a"))
    assert tall._jdf.queryExecution().analyzed().toString().count(", StringType, false") == 1


def test_differences_of_many_pairs_broadcast_nothing(spark, tmp_path):
    entries_of(spark, [{"ts": i, "msg": f"m{i // 2}"} for i in range(40)]).select("seq", "fields").write.parquet(f"{tmp_path}/rows")
    spark.range(39).selectExpr("id as left", "id + 1 as right").write.parquet(f"{tmp_path}/pairs")
    found = retrieve.diff_rows(spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/pairs"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert Counter(r["path"] for r in found.collect()) == {"ts": 39, "msg": 19}


def test_facets(spark, parcels):
    counts = facets.facet_counts(parcels)
    assert {(r["value"], r["n"]) for r in counts.where("path = 'service'").collect()} == {("belt/east", 1), ("belt/west", 1), ("gate", 2), ("desk", 1)}
    assert {(r["value"], r["n"]) for r in counts.where("path = 'parcel.grams'").collect()} == {("950", 1), ("1200", 1), ("heavy", 1)}
    assert facets.rank_facets(counts, ["msg"]).first()["path"] == "msg"
    assert [r["value"] for r in facets.facet_values(counts, "service", "BELT", ["belt/west"]).collect()] == ["belt/west", "belt/east"]
    assert [r["value"] for r in facets.suggest_values(counts, "service").collect()] == ["gate", "belt/east", "belt/west", "desk"]
    deep = {"x": 1}
    for k in "fedcba":
        deep = {k: deep}
    df = entries_of(spark, [{"msg": "m", **deep}, {"msg": 'quoted "{{{" braces', "l": [{"p": {"q": {}}}]}])
    assert paths.deepest(df) == 7 and paths.deepest(parcels) == 2
    assert [r["path"] for r in facets.facet_counts(df, max_depth=7).where("path like 'a%'").collect()] == ["a.b.c.d.e.f.x"]
    assert facets.facet_counts(df, max_depth=6).where("path like 'a%'").count() == 0


def test_recommended_columns(spark):
    rows = [{"ts": i, "msg": f"m{i}", "caller": "a", "level": "info", "service": "s", "seq": i % 4, "trace": f"{i:016x}", "d": {"e": {"f": i % 2}}} for i in range(30)]
    rows += [{"timestamp": "2026-05-26T00:00:00Z", "message": f"m{i}", "logger": "b", "level": "warn", "lineno": i} for i in range(30)]
    got = [r["column"] for r in columns.recommend_columns(entries_of(spark, rows)).orderBy("position").collect()]
    assert got == ["ts", "level", "msg", "service", "caller"]
    alone = [r["column"] for r in columns.recommend_columns(entries_of(spark, rows[:30])).orderBy("position").collect()]
    assert alone == ["ts", "level", "msg", "service", "caller", "@seq"]
    merged = columns.merge_columns(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("b", 2, "y")], "source string, position int, column string"))
    assert [r["column"] for r in merged.orderBy("position").collect()] == ["y", "x", "z"]


def test_rate(spark):
    per = [3, 0, 5, 1]
    rate = 0.0
    for n in per:
        rate = 0.3 * n + 0.7 * rate
    df = spark.createDataFrame([("s", 100.0 + i + 0.5) for i, n in enumerate(per) for _ in range(n)], "source string, ts double")
    assert abs(aggregate.rate_ewma(df, 103.9).first()["rate"] - rate) < 1e-6


def test_files(spark, parcels, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\n\ntwo\n")
    got = files.read_logs(spark, f"file://{tmp_path}/a.log").orderBy("seq").collect()
    assert [r["line"] for r in got] == ["one\r", "", "two"] and got[0]["source"].endswith("a.log")
    files.export_jsonl(parcels, f"file://{tmp_path}/out", p.eq("service", "gate"), limit=1)
    out = [json.loads(r["value"]) for r in spark.read.text(f"file://{tmp_path}/out").collect()]
    assert len(out) == 1 and out[0]["seq"] == 2 and out[0]["fields"]["msg"] == "Gate 3: arm stuck"


def test_paths(spark):
    leaves = paths.explode_paths(entries_of(spark, [{"msg": "x", "a": {"b": {"c": {"d": {"e": 1}}}}, "l": [1], "e": [], "s": [None, {"t": 1}], "n": None, "o": {}, "1e3": 1e3}]), max_depth=4).collect()
    assert {(r["path"], r["value"], r["depth"]) for r in leaves} == {("msg", "x", 1), ("a.b.c.d", '{"e":1}', 4), ("l", "[1]", 1), ("e", "[]", 1), ("s", '[null,{"t":1}]', 1), ("n", None, 1), ("o", "{}", 1), ("1e3", "1000", 1)}


def test_streamed_files_resume_behind_the_cursor(spark, tmp_path):
    (tmp_path / "in").mkdir()
    where, seen = p.eq("level", "error"), []
    for name, n in (("a", 3), ("b", 2)):
        (tmp_path / "in" / f"{name}.log").write_text("".join(json.dumps({"level": "error" if i % 2 == 0 else "info", "msg": f"{name}{i}"}) + "\n" for i in range(n)))
        stream = normalize(files.stream_logs(spark, f"file://{tmp_path}/in")).drop("fields")
        live.live_tail(stream, where, f"file://{tmp_path}/out", f"file://{tmp_path}/cursor", once=True).awaitTermination()
        seen.append(sorted(r["msg"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()))
    assert seen == [["a0", "a2"], ["a0", "a2", "b0"]]


def test_followed_lines_keep_their_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    want = []
    for name in ("b", "a"):
        lines = [f"{name}{i // 3}" for i in range(40)]
        (tmp_path / "in" / f"{name}.log").write_text("\n".join(lines) + "\n")
        want += lines
        files.follow_logs(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/t", f"file://{tmp_path}/c", once=True).awaitTermination()
    got = files.read_followed(spark, f"file://{tmp_path}/t").orderBy("seq").collect()
    assert [r["line"] for r in got] == want and len({r["seq"] for r in got}) == 80
    assert [r["line"] for r in retrieve.tail_recent(files.read_followed(spark, f"file://{tmp_path}/t"), 2).collect()] == ["a12", "a13"]


def stream_of(spark, path, rows, schema):
    """Writes some rows as one more file and gives the folder as a stream."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_a_full_sample_closes(spark, tmp_path):
    schema, path = "source string, seq long, line string, ingest_ts timestamp", f"file://{tmp_path}"
    for turn in range(3):
        rows = [(s, turn * 100 + i, json.dumps({"msg": f"{s}{i}", f"k{turn}": i}), NOW) for s in ("a", "b") for i in range(4 if s == "a" else 1)]
        live.stream_recommend(normalize(stream_of(spark, f"{path}/in", rows, schema)), f"{path}/t", f"{path}/c", sample=6, once=True).awaitTermination()
    # a is closed by six rows of two batches; b has three and stays open.
    assert [(r["source"], r["position"], r["column"]) for r in live.read_recommended(spark, f"{path}/t").orderBy("position").collect()] == [("a", 1, "msg"), ("a", 2, "@k0")]


def test_a_silent_source_is_closed_by_its_timer(spark, tmp_path):
    schema, path = "source string, seq long, line string, ingest_ts timestamp", f"file://{tmp_path}"
    rows = [("quiet", i, json.dumps({"msg": f"m{i}", "level": "info"}), NOW) for i in range(20)]
    query = live.stream_samples(normalize(stream_of(spark, f"{path}/in", rows, schema)), closes=3.0).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"{path}/c").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(120):
            if spark.table("closed").count():
                break
            time.sleep(0.5)
        assert [(r["source"], r["n"], r["seq"]) for r in spark.table("closed").orderBy("n").collect()] == [("quiet", i + 1, i) for i in range(20)]
        stream_of(spark, f"{path}/in", [("quiet", 99, '{"msg":"late"}', NOW)], schema)
        time.sleep(3)
        assert spark.table("closed").count() == 20
    finally:
        query.stop()


def test_a_growing_file(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    log, seen = tmp_path / "in" / "a.log", []

    def turn():
        files.follow_logs(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/t", f"file://{tmp_path}/c", once=True).awaitTermination()
        rows = files.read_followed(spark, f"file://{tmp_path}/t").orderBy("seq").collect()
        assert [r["seq"] for r in rows] == list(range(len(rows)))
        seen.append([r["line"] for r in rows])

    log.write_bytes(b"one\r\n\nthr")
    turn()
    with log.open("ab") as f:
        f.write("ee\nfünf\nsix".encode())
    turn()
    log.write_bytes(b"new\n")  # truncated
    turn()
    with log.open("ab") as f:
        f.write(b"newer\n")
    (tmp_path / "in" / "b.log").write_bytes(b"other\n")
    turn()
    first, second = ["one\r", ""], ["three", "fünf"]
    assert seen == [first, first + second, first + second + ["new"], first + second + ["new", "newer", "other"]]


def test_ranges_of_a_file_have_its_lines_once(tmp_path, monkeypatch):
    text = b"".join(b"x" * (i * 7 % 23) + b"\n" for i in range(200)) + b"open end"
    (tmp_path / "a.log").write_bytes(text)
    for split in (1, 5, 40, 10_000):
        monkeypatch.setattr(growing, "SPLIT", split)
        monkeypatch.setattr(growing, "LOOK", 16)
        reader = growing._Reader({"path": f"file://{tmp_path}"})
        end = reader.latestOffset()
        rows = [r for part in reader.partitions({}, end) for r in reader.read(part)]
        assert [r[2].encode() for r in rows] == text.split(b"\n")[:-1]
        assert all(text[at:].startswith(line.encode() + b"\n") for _, at, line in rows)


def test_windows_open_few_days(spark, tmp_path):
    day = 86_400
    lines = [{"ts": d * day + i * 60, "msg": f"{d}:{i}", "a": {"b": d}} for d in range(5) for i in range(3)] + [{"ts": 1.8e15, "msg": "far"}, {"ts": -9e12, "msg": "long ago"}]
    files.write_table(entries_of(spark, lines), f"file://{tmp_path}/t")
    got = files.read_table(spark, f"file://{tmp_path}/t", day + 60, 3 * day + 60)
    assert sorted(r["msg"] for r in got.collect()) == ["1:1", "1:2", "2:0", "2:1", "2:2", "3:0"]
    assert [r["x"] for r in got.select(paths.path_text("a.b").alias("x")).distinct().orderBy("x").collect()] == ["1", "2", "3"]
    shown = checks.plan(got)
    filters = next(x for x in shown.splitlines() if "PartitionFilters" in x)
    assert "date" in filters and ">= 1970-01-02" in filters and "<= 1970-01-04" in filters
    assert sorted(r["msg"] for r in files.read_table(spark, f"file://{tmp_path}/t", 5 * day).select("msg").collect()) == ["far"]
    assert sorted(r["msg"] for r in files.read_table(spark, f"file://{tmp_path}/t", 0, 1).select("msg").collect()) == ["0:0", "long ago"]


def test_unused_columns_are_not_worked_out(spark):
    shown = checks.plan(normalize(lines_of(spark, [{"msg": "x"}])).select("msg"))
    assert "message" in shown and not any(x in shown for x in ("trace_id", "regexp_extract_all", "emergency"))


def test_gaps_of_a_stream_are_those_of_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "COMPACT", 2)
    monkeypatch.setattr(live, "RANGE", 10)
    schema, path = "source string, seq long, line string, ingest_ts timestamp", f"file://{tmp_path}"
    numbers = [n for n in range(60) if n % 9 != 4 and n not in (20, 21, 22)]
    random.Random(5).shuffle(numbers)
    batches = [numbers[k::4] + numbers[:3] for k in range(4)] + [[21]]
    for k, batch in enumerate(batches):
        rows = [(s, n, "x", NOW) for n in batch for s in ("a", "b") if s == "a" or n != 30]
        live.stream_gaps(normalize(stream_of(spark, f"{path}/in", rows, schema)), f"{path}/t", f"{path}/c", once=True).awaitTermination()
        if k >= 3:
            key = lambda r: (r["source"], r["after_seq"], r["before_seq"], r["n_missing"])
            table = normalize(spark.read.schema(schema).parquet(f"{path}/in"))
            assert sorted(map(key, live.read_gaps(spark, f"{path}/t").collect())) == sorted(map(key, aggregate.detect_gaps(table.dropDuplicates(["source", "seq"])).collect()))
    assert live.read_gaps(spark, f"{path}/t", settled=3600).count() == 0


def test_readers_outlive_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "COMPACT", 2)
    path = f"file://{tmp_path}/f"
    add = lambda k: live._add(spark.createDataFrame([("p", "v", 1)], live.FACETS), k, path, live.FACETS, live._summed)
    for k in range(3):
        add(k)
    reader = live.read_facets(spark, path)
    add(3)
    assert reader.first()["n"] == 3 and live.read_facets(spark, path).first()["n"] == 4


def test_first_rows_by_counts(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "RANGES", 3)
    numbers = [random.Random(i).randrange(-50, 90) for i in range(200)] + [None]
    df = spark.createDataFrame([(n,) for n in numbers], "seq long")
    known = sorted(n for n in numbers if n is not None)
    for n in (1, 2, 77, 199, 200, 500):
        assert sorted(r["seq"] for r in retrieve.first_rows(df, n).collect()) == known[:n]
    assert retrieve.first_rows(df.limit(0), 5).collect() == []


def test_a_large_export_is_in_order_across_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ONE_TASK", 10)
    df = entries_of(spark, [{"msg": f"m{i}"} for i in range(300)]).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.export_jsonl(df, f"file://{tmp_path}/out", start=20, limit=150)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [[json.loads(x)["seq"] for x in f.read_text().splitlines()] for f in sorted((tmp_path / "out").glob("part-*"))]
    assert sum(parts, []) == list(range(20, 170)) and len([x for x in parts if x]) > 1


def test_values_of_any_type_are_shared(spark):
    long = "y" * 300
    lines = [{"msg": "x", "a": 1, "b": {"c": [1, {"d": None}]}, 'k"e\\y\n': long, "t": True, "n": None, "f": 2.5, "e": {}, "z": []} for _ in range(3)] + [{"msg": long, "a": 1}, "plain text"]
    df = entries_of(spark, lines)
    facts, payloads = columns.share_values(df)
    want = {r["seq"]: r["j"] for r in df.select("seq", F.to_json("fields").alias("j")).collect()}
    assert {r["seq"]: r["j"] for r in columns.restore_values(facts, payloads).select("seq", F.to_json("fields").alias("j")).collect()} == want
    uses = {r["payload"]: r["n_uses"] for r in payloads.collect()}
    assert uses == {"1": 4, '{"c":[1,{"d":null}]}': 3, json.dumps(long): 4, "true": 3, "null": 3, "2.5": 3, "{}": 3, "[]": 3}


@pytest.mark.parametrize("shares", [1024, 3])
def test_restoring_values_broadcasts_no_payloads(spark, tmp_path, monkeypatch, shares):
    monkeypatch.setattr(columns, "SHARES", shares, raising=False)
    lines = [{"msg": f"m{i}", "a": True, "b": i % 2, "c": {"d": [i]}} for i in range(60)] + [{"msg": "none"}, "plain text"]
    df = entries_of(spark, lines)
    for name, part in zip(("facts", "payloads"), columns.share_values(df)):
        part.write.parquet(f"{tmp_path}/{name}")
    whole = columns.restore_values(*(spark.read.parquet(f"{tmp_path}/{name}") for name in ("facts", "payloads"))).select("seq", F.to_json("fields").alias("j"))
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and plan.count("SortMergeJoin") == 2  # digests of frequent payloads only
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, df.select("seq", F.to_json("fields").alias("j")).collect()))


def test_rows_with_one_key_keep_their_own_values(spark):
    df = entries_of(spark, [{"msg": f"m{i}", "a": i, "b": True} for i in range(3)]).withColumn("seq", F.lit(7))
    whole = columns.restore_values(*columns.share_values(df)).select("msg", F.to_json("fields").alias("j"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, df.select("msg", F.to_json("fields").alias("j")).collect()))


def test_partial_results_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "COMPACT", 2)
    path = f"file://{tmp_path}"
    for turn in range(5):
        rows = [("s", turn, json.dumps({"level": "info", "service": "a" if turn % 2 else "b", "msg": "m", "timestamp": f"2031-01-01T00:{turn:02}:30Z"}), NOW)]
        stream = normalize(stream_of(spark, f"{path}/in", rows, "source string, seq long, line string, ingest_ts timestamp"))
        live.stream_facets(stream, f"{path}/f", f"{path}/fc", once=True).awaitTermination()
        live.stream_histogram_table(stream, f"{path}/h", f"{path}/hc", "2 minutes", once=True).awaitTermination()
    assert {(r["value"], r["n"]) for r in live.read_facets(spark, f"{path}/f").where("path = 'service'").collect()} == {("a", 2), ("b", 3)}
    assert len([x for x in (tmp_path / "f").iterdir() if x.is_dir()]) <= 5
    got = sorted((r["t"].minute, r["info"]) for r in live.read_histogram(spark, f"{path}/h", "2 minutes").collect())
    assert got == [(0, 2), (2, 2), (4, 1)]
    finer = sorted((r["t"].minute, r["info"]) for r in live.read_histogram(spark, f"{path}/h", "1 minute").collect())
    assert finer == [(0, 2), (1, 0), (2, 2), (3, 0), (4, 1)]


def test_history_then_live_without_repeats(spark, tmp_path):
    schema, path = "source string, seq long, line string, ingest_ts timestamp", f"file://{tmp_path}"
    rows = [("s", i, json.dumps({"msg": f"m{i}", "level": "warn"}), NOW) for i in range(9)]
    stream = normalize(stream_of(spark, f"{path}/in", rows[:5], schema)).drop("fields")
    history = normalize(spark.createDataFrame(rows[:5], schema)).drop("fields")
    for more in (rows[5:7], rows[7:]):
        past, running = live.backlog_then_live(history, stream, p.eq("level", "warn"), f"{path}/out", f"{path}/c", 3, once=True)
        running.awaitTermination()
        assert [r["seq"] for r in past.collect()] == [2, 3, 4]
        history = normalize(spark.createDataFrame(rows[: more[-1][1] + 1], schema)).drop("fields")  # the table has grown meanwhile
        stream_of(spark, f"{path}/in", more, schema)
    live.backlog_then_live(history, stream, p.eq("level", "warn"), f"{path}/out", f"{path}/c", 3, once=True)[1].awaitTermination()
    assert sorted(r["seq"] for r in spark.read.parquet(f"{path}/out").collect()) == [5, 6, 7, 8]


def test_gap_on_resume(spark):
    table = spark.range(50, 60).select(F.col("id").alias("seq"))
    assert [tuple(r) for r in live.resume_gap(table, 40).collect()] == [(40, 50, 9)]
    assert live.resume_gap(table, 49).collect() == [] and live.resume_gap(table, 55).collect() == [] and live.resume_gap(table, 99).collect() == []


def test_cuts_of_a_table(spark, tmp_path):
    day, path = 86_400, f"file://{tmp_path}/t"
    row = lambda d, s, m: {"ts": d * day + s, "msg": m, "a": m}
    put = lambda *lines, **mode: files.write_table(entries_of(spark, list(lines)), path, **mode)
    table = lambda: files.read_table(spark, path)
    msgs = lambda t: sorted(r["msg"] for r in t.select("msg").collect())
    assert retention.cut_before(spark, path, 5.0) == 0 and retention.sweep(spark, path, 0) == 0
    put(*(row(d, s, f"{d}:{s}") for d in range(4) for s in (1, 2, 3)), "a line without a time")
    opened = table()
    everything = msgs(opened)
    assert retention.cut_before(spark, path, 2 * day + 2) == 1
    assert msgs(table()) == ["2:2", "2:3", "3:1", "3:2", "3:3", "a line without a time"]
    assert retention.sweep(spark, path) == 0 and msgs(opened) == everything  # a reader of before the cut goes on
    put(row(2, 1, "too late"), row(2, 9, "late"), row(0, 7, "far too late"))
    assert msgs(table()) == ["2:2", "2:3", "3:1", "3:2", "3:3", "a line without a time", "late"]
    assert retention.cut_before(spark, path, 2 * day) == 1  # back in time: nothing
    halfway = table()
    assert retention.cut_before(spark, path, 2 * day + 3) == 2
    left = ["2:3", "3:1", "3:2", "3:3", "a line without a time", "late"]
    assert msgs(table()) == left and msgs(halfway)[0] == "2:2"
    assert retention.sweep(spark, path, 0) > 0 and msgs(table()) == left
    assert not [d for d in (tmp_path / "t").glob("date=1970-01-0[12]")] and not list((tmp_path / "t" / "date=1970-01-03").rglob("*.parquet"))
    assert [x.name for x in (tmp_path / "t-kept").iterdir() if x.is_dir()] == ["cut=2"]
    put(row(2, 4, "2:4"))
    shown = checks.plan(files.read_table(spark, path, 3 * day, 3 * day + 2))
    assert "date" in next(x for x in shown.splitlines() if "PartitionFilters" in x)
    assert msgs(files.read_table(spark, path, 2 * day, 3 * day + 2)) == ["2:3", "2:4", "3:1", "late"]
    assert table().select(paths.path_text("a").alias("a")).where("a = 'late'").count() == 1
    retention.cut_before(spark, path, 9 * day)
    retention.sweep(spark, path, 0)
    assert msgs(table()) == ["a line without a time"]
    put(row(1, 1, "anew"), mode="overwrite")
    assert msgs(table()) == ["anew"]


def test_facets_taken_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "COMPACT", 2)
    path, schema = f"file://{tmp_path}", "source string, seq long, line string, ingest_ts timestamp"
    kept, before = [], None
    for turn in range(6):
        rows = [(s, 10 * turn + i, json.dumps({"msg": f"m{i % 2}", "service": f"of {s}", "crew": str(turn)}), NOW) for i in range(3) for s in ("a", "b", "c")]
        kept += rows
        stream = normalize(stream_of(spark, f"{path}/in", rows, schema))
        live.stream_source_facets(stream, f"{path}/f", f"{path}/c", once=True).awaitTermination()
        for source in {1: ["a"], 2: ["b", "never seen"], 4: ["a", "b"]}.get(turn, []):
            before = live.read_source_facets(spark, f"{path}/f"), len(kept)
            live.take_back(spark, f"{path}/f", source)
            kept = [r for r in kept if r[0] != source]
        got = {(r["path"], r["value"], r["n"]) for r in live.read_source_facets(spark, f"{path}/f").collect()}
        want = facets.facet_counts(normalize(spark.createDataFrame(kept, schema)))
        assert got == {(r["path"], r["value"], r["n"]) for r in want.collect()}, turn
    assert before[0].where("path = 'msg'").agg(F.sum("n")).first()[0] == before[1]  # a reader of before goes on


def test_bounded_facets_are_made_exact(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "COMPACT", 2)
    path, schema = f"file://{tmp_path}", "source string, seq long, line string, ingest_ts timestamp"
    draw, kept = random.Random(7), []
    for turn in range(4):
        lines = [{"msg": f"{turn}:{i}", "few": i % 3, "skewed": "often" if draw.random() < 0.6 else f"{draw.random()}", "flat": f"v{i % 90}"} for i in range(400)]
        rows = [("s", 1000 * turn + i, json.dumps({**x, "level": "info"}), NOW) for i, x in enumerate(lines)]
        kept += rows
        live.stream_top_facets(normalize(stream_of(spark, f"{path}/in", rows, schema)), f"{path}/f", f"{path}/c", 16, once=True).awaitTermination()
    named, table = live.read_top_facets(spark, f"{path}/f", 16), normalize(spark.createDataFrame(kept, schema))
    rows = named.collect()
    exact = {(r["path"], r["value"]): r["n"] for r in facets.facet_counts(table).collect()}
    assert all(abs(r["n"] - exact[r["path"], r["value"]]) <= r["unsure"] for r in rows if r["value"] is not None)
    assert {r["path"]: r["total"] for r in rows}["skewed"] == 1600 and {r["path"] for r in rows} == {p for p, _ in exact}
    assert len(rows) <= 16 * len({r["path"] for r in rows}) and "often" in {r["value"] for r in rows}
    assert {(p, v) for (p, v), n in exact.items() if n > 2 * 3.5 / 16 * 1600} <= {(r["path"], r["value"]) for r in rows}
    for top in (1, 5, 50):
        got = live.exact_top_facets(table, named, top=top).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, facets.facets(table, top=top).select("path", "value", "n", "rank").collect()))
    assert {r["path"] for r in live.exact_top_facets(table, named, top=2, keys=3).collect()} == {r["path"] for r in facets.facets(table, top=2, keys=3).collect()}
