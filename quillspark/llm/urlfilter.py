"""URL filter: a broadcast trie over reversed host labels, then path segments; the longest rule wins.

Rules are (verdict, host, path), a list or a DataFrame. At most TRIE_RULES of them are broadcast as a trie; more are met by shuffle:
URLs under each suffix of their host with that host's path lengths, then with the rules themselves. A rule fits its host and every subdomain, if the URL's path starts with the
rule's path (which may end inside a segment). Among the rules that fit, the one with more host labels wins, then
the one with the longer path; equal rules with both verdicts resolve to block. Defined cases: a null URL, or one
without "://", has empty host and path and fits no rule unless the rule's host is empty too; a URL that fits no
rule gets `default`; null verdicts, hosts or paths in rules: such a rule is left out. Repeated rows are judged alike; an empty table gives
no rows; other columns pass through; columns named host, path, rule and verdict are replaced.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import unused

#: The trie travels with every task, at a few hundred bytes a rule: more rules than this are joined instead.
TRIE_RULES = 100_000
#: The contract's rules.
CONTRACT_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased; null or no ://: empty."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class RuleTrie:
    """Node: [children by label, path root]; path node: [children by whole segment, open prefixes, verdict here].

    The path "/en/7" has the whole segments "" and "en", and the open prefix "7" at their node.
    """

    def __init__(self, rules):
        self.root: list = [{}, None]
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, {}]
            at = node[1]
            *whole, last = path.split("/")
            for segment in whole:
                at = at[0].setdefault(segment, [{}, {}])
            if at[1].get(last, ("", ""))[0] != "block":
                at[1][last] = (verdict, host + path)

    def find(self, host: str, path: str):
        """(verdict, rule) of the longest rule that fits, or None."""
        roots, node = [self.root[1]], self.root
        for label in reversed(host.split(".")) if host else ():
            node = node[0].get(label)
            if node is None:
                break
            roots.append(node[1])
        segments = path.split("/")
        for root in reversed(roots):
            at, best = root, None
            for segment in segments:
                if at is None:
                    break
                fits = [p for p in at[1] if segment.startswith(p)] if len(at[1]) <= len(segment) else [segment[:k] for k in range(len(segment) + 1) if segment[:k] in at[1]]
                if fits:
                    best = at[1][max(fits, key=len)]
                at = at[0].get(segment)
            if best:
                return best
        return None


def judge_urls(df: DataFrame, rules, url: str = "url", default: str = "allow", most: int = TRIE_RULES) -> DataFrame:
    """df with host, path, rule (null if none fits) and verdict; more than `most` rules are joined, not broadcast."""
    out = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if isinstance(rules, DataFrame):
        table = rules.select("verdict", "host", "path").na.drop()
        first = table.limit(most + 1).collect()  # bounded by `most`
        if len(first) > most:
            return _joined(out, table, default)
        rules = [tuple(r) for r in first]
    rules = [r for r in rules if None not in r]
    if len(rules) > most:
        return _joined(out, df.sparkSession.createDataFrame(rules, "verdict string, host string, path string"), default)
    trie = df.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf("verdict string, rule string")
    def look(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        find = trie.value.find
        found = [find(h, p) or (default, None) for h, p in zip(host, path)]
        return pd.DataFrame(found, columns=["verdict", "rule"], dtype=object)

    at = unused(out, "_found")
    out = out.withColumn(at, look("host", "path"))
    return out.withColumns({"rule": F.col(at)["rule"], "verdict": F.col(at)["verdict"]}).drop(at)


def _joined(out: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by joins on distinct (host, path): no rule list is held in one place, and Spark can split a frequent host."""
    one = rules.groupBy(F.col("host").alias("rhost"), F.col("path").alias("rpath")).agg(F.max("verdict").alias("verdict"))  # block over allow
    lengths = one.groupBy("rhost").agg(F.sort_array(F.collect_set(F.char_length("rpath"))).alias("lengths"))  # at most as many as a path is long
    urls = out.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(k.alias("n"), F.array_join(F.slice(labels, -k, k), ".").alias("rhost")))
    suffixes = F.concat(F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("rhost"))), F.when(F.col("host") == "", F.array().cast("array<struct<n:int,rhost:string>>")).otherwise(suffixes))
    near = urls.select("host", "path", F.explode(suffixes).alias("s")).select("host", "path", "s.*").join(lengths, "rhost")
    fits = F.filter("lengths", lambda k: k <= F.char_length("path"))
    tried = near.select("host", "path", "n", "rhost", F.explode(fits).alias("k")).withColumn("rpath", F.expr("substring(path, 1, k)"))
    best = tried.join(one, ["rhost", "rpath"]).groupBy("host", "path").agg(F.max(F.struct("n", "k", "verdict", F.concat("rhost", "rpath").alias("rule"))).alias("b"))
    best = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("b.verdict").alias("_v"), F.col("b.rule").alias("_r"))
    met = out.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return met.withColumns({"rule": F.col("_r"), "verdict": F.coalesce("_v", F.lit(default))}).drop("_h", "_p", "_v", "_r")


def op6_urlfilter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, CONTRACT_RULES).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH u AS (SELECT page_id,
  coalesce(lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'),
  ('block','example.net','/de/8'), ('block','org','/es/')),
m AS (SELECT u.page_id, u.host, u.path, r.verdict, rhost || rpath AS rule,
  row_number() OVER (PARTITION BY u.page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS k
  FROM u LEFT JOIN r ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
