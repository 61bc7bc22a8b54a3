"""URL filter: a trie over reversed host labels, then path segments."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_names, fresh

#: Rules that may be broadcast as one trie; larger lists take the join.
MAX_TRIE_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    """action: allow or block. text: host and path, like example.net/en/. A-Z in
    the host are lower-cased, as those of a url are."""

    action: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].translate({i: i + 32 for i in range(65, 91)})

    @property
    def path(self) -> str:
        host, slash, rest = self.text.partition("/")
        return slash + rest


class Trie:
    """A node is a dict: label or segment -> node; "" is never a key of a host
    node's own table, which keeps hosts and paths apart:
    hosts[label] -> (hosts, paths); paths: {segments tuple step -> node}."""

    def __init__(self, rules: Iterable[Rule]):
        self.root = self._node()
        for r in sorted(set(rules), key=lambda r: (r.text, r.action)):
            node = self.root
            for label in reversed(r.host.split(".")):
                node = node["hosts"].setdefault(label, self._node())
            path = node["path"]
            *whole, last = r.path.split("/")
            for segment in whole:
                path = path["next"].setdefault(segment, {"next": {}, "prefix": {}})
            # block sorts after allow and so wins between equal texts
            path["prefix"][last] = (r.action, r.text)

    @staticmethod
    def _node() -> dict:
        return {"hosts": {}, "path": {"next": {}, "prefix": {}}}

    @staticmethod
    def _walk(path: dict, url_path: str):
        """The rule with the longest path below one host node."""
        best, rest = None, url_path.split("/")
        for i, segment in enumerate(rest):
            whole = segment if i == len(rest) - 1 else None
            fits = [p for p in path["prefix"] if segment.startswith(p)]
            if fits:
                best = path["prefix"][max(fits, key=len)]
            if whole is not None or segment not in path["next"]:
                break
            path = path["next"][segment]
        return best

    def match(self, host: str, url_path: str):
        """(action, rule) of the longest rule that fits, else (None, None).

        A rule with more host labels is longer; among those with the same
        host, the one with the longer path.
        """
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node["hosts"].get(label)
            if node is None:
                break
            best = self._walk(node["path"], url_path) or best
        return best or (None, None)


def split_url(url):
    """Host (A-Z lower-cased) and path columns; both empty without '://'."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(u, "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(u, "://[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    Nulls and urls without '://' have empty host and path, fit no rule and get
    the default verdict; so does a path that doesn't start with the rule's (an
    empty path doesn't start with '/'). Repeated rows are judged alike, an
    empty table gives an empty result, and input columns named like the new
    ones are replaced. If two rules have the same text, block wins.

    The trie is broadcast; a list of more than MAX_TRIE_RULES rules is joined
    by its (host, path) instead, so nothing unbounded is sent to executors.
    """
    host, path = split_url(F.col(url_col))
    names = [fresh(pages, c) for c in ("host", "path", "m")]
    df = clear_names(pages.withColumns({names[0]: host, names[1]: path}), "host", "path", "rule", "verdict")
    df = df.withColumnsRenamed({names[0]: "host", names[1]: "path"})
    if len(rules) > MAX_TRIE_RULES:
        return _by_join(df, rules, default)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("action string, rule string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        match = trie.value.match
        return pd.DataFrame([match(h, p) for h, p in zip(hosts, paths, strict=True)], columns=["action", "rule"])

    m = names[2]
    out = df.withColumn(m, judge("host", "path"))
    return out.withColumns({"rule": F.col(f"{m}.rule"), "verdict": F.coalesce(f"{m}.action", F.lit(default))}).drop(m)


def _by_join(df: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """Equi-join of each url's host suffixes with the rules' hosts, then the
    longest of those whose path fits; urls are joined once each."""
    spark = df.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.text, r.action) for r in set(rules)], "rh string, rp string, rule string, action string")
    labels = F.split("host", r"\.")
    n = F.size(labels)
    tails = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    urls = df.select("host", "path").distinct()
    hits = urls.select("host", "path", F.explode(tails).alias("rh")).join(table, "rh").where(F.expr("startswith(path, rp)"))
    order = F.struct(F.size(F.split("rh", r"\.")), F.length("rp"), F.when(F.col("action") == "block", 1).otherwise(0))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), order).alias("m"))
    out = df.join(best, ["host", "path"], "left").select(*df.columns, F.col("m.rule").alias("rule"), F.coalesce("m.action", F.lit(default)).alias("verdict"))
    return out
