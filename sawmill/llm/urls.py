"""Operator 8: URL filter by a trie over reversed host labels and path segments.

Labels from the right lead to a node; from there whole path segments lead on. The
last segment of a rule may be the beginning of a url's segment. The longest rule
that fits decides, whichever list it is on.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: What urls get that no rule fits.
DEFAULT = "allow"
#: A trie of at most so many characters of rules is broadcast; more rules are joined by host.
BROADCAST_CHARS = 8_000_000


def host() -> Column:
    after = F.expr("substring(url, instr(url, '://') + 3)")
    return F.when(F.contains("url", F.lit("://")), F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path() -> Column:
    after = F.expr("substring(url, instr(url, '://') + 3)")
    return F.when(F.contains("url", F.lit("://")), F.regexp_extract(after, r"(?s)^[^/?#]*(/?[^?#]*)", 1)).otherwise("")


class Trie:
    """Rules by host label, then by path segment; ``best`` follows one url down."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for verdict, rule in rules:
            name, _, rest = rule.partition("/")
            node = self.root
            for label in reversed(name.split(".")):
                node = node.setdefault("." + label, {})
            *whole, last = rest.split("/")
            for segment in whole:
                node = node.setdefault("/" + segment, {})
            ends = node.setdefault("", {})  # by length, then by text
            ends = ends.setdefault(len(last), {})
            have = ends.get(last)
            if have is None or have[0] == "allow":  # the same rule on both lists blocks
                ends[last] = (verdict, rule)

    def best(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits; of two as long, that of the longer host."""
        found = None
        node, labels = self.root, host.split(".")
        segments = path[1:].split("/") if path.startswith("/") else []
        for label in reversed(labels):
            node = node.get("." + label)
            if node is None:
                break
            at = node
            for i, segment in enumerate(segments):
                for k, ends in at.get("", {}).items():  # as many lengths as rules end here with, however long the url is
                    hit = ends.get(segment[:k])
                    if hit and (found is None or len(hit[1]) >= len(found[1])):
                        found = hit
                at = at.get("/" + segment)
                if at is None:
                    break
        return found


def judged(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = DEFAULT, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url; other columns are ignored).

    Null urls and those without ``://`` have an empty host and path, and the default verdict. Repeated rows repeat.
    """
    rules = list(rules)
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")).select("page_id", host().alias("host"), path().alias("path"))
    if sum(len(r) for _, r in rules) > broadcast_chars:
        return _joined(rows, rules, default)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def look(hosts, paths):
        import pandas as pd

        found = [trie.value.best(h, p) for h, p in zip(hosts, paths)]
        return pd.DataFrame({"rule": [f[1] if f else None for f in found], "verdict": [f[0] if f else default for f in found]}, dtype=object)

    return rows.withColumn("hit", look("host", "path")).select("page_id", "host", "path", "hit.rule", "hit.verdict")


def _joined(rows: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """The same for any number of rules: every distinct url meets the rules of its host and the hosts above it."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(v, r, *r.split("/", 1)) for v, r in rules], "verdict string, rule string, name string, rest string").withColumn("rest", F.concat(F.lit("/"), "rest"))
    labels, most = F.split("host", r"\."), max(r.partition("/")[0].count(".") for _, r in rules) + 1  # no rule has more labels
    urls = rows.select("host", "path").distinct()
    names = urls.select("host", "path", F.explode(F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - most + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("name"))
    fits = names.join(table, "name").where(F.startswith("path", "rest"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.length("name").alias("m"), F.col("verdict").alias("v"), "rule", "verdict")).alias("hit")).select("host", "path", "hit.rule", "hit.verdict")
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op8_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    return f"""
with u as (select page_id, case when url like '%://%' then substr(url, instr(url, '://') + 3) else '' end as r from pages),
     p as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  regexp_extract(r, '^[^/?#]*(/?[^?#]*)', 1) as path from u),
     rules(v, rule, name, rest) as (values {rules}),
     best as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(v, length(rule)) as v
              from p, rules where (host = name or ends_with(host, '.' || name)) and starts_with(path, rest) group by page_id)
select p.page_id, p.host, p.path, best.rule, coalesce(best.v, '{DEFAULT}') as verdict from p left join best using (page_id)"""


ORACLE = _oracle()
