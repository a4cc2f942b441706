"""URL allow and block lists as a trie over reversed host labels and path segments."""

from __future__ import annotations

import string
from bisect import insort
from collections.abc import Iterable, Iterator
from operator import neg

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A list of more rules than this isn't broadcast (a rule takes about 1 kB at most) but joined by shuffle.
MAX_RULES = 200_000

VERDICTS = ("allow", "block")

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "#?":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class UrlTrie:
    """Rules by reversed host label, then by path segment.

    A node is a dict of children; ``None`` leads from a host node to its paths. A path node keeps
    the rules that end there, by what they ask of the next, unfinished segment ('' asks nothing), and
    the lengths of that, longest first: a segment is looked up once for each length.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        """``rules``: (host and path as one string, 'allow' or 'block'); block wins between equal rules."""
        self.root: dict = {}
        self.free: dict = {}
        for rule, verdict in rules:
            if verdict not in VERDICTS:
                raise ValueError(f"neither allow nor block: {verdict!r}")
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(label, {})
            if not slash:
                ends, key = node.setdefault(("any",), {}), ""
            else:
                *whole, key = path.split("/")
                node = node.setdefault(None, {})
                for segment in whole:
                    node = node.setdefault(("/", segment), {})
                ends = node.setdefault(("ends",), {})
            if ends.get(key, ("", ""))[1] != "block":
                ends[key] = (rule, verdict)
            if slash and len(key) not in (lengths := node.setdefault(("lengths",), [])):
                insort(lengths, len(key), key=neg)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits: the one with most host labels, among those the one with the longest path."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            found = self._path(node, path)
            best = found or best
        return best

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        best = node.get(("any",), {}).get("")
        node = node.get(None)
        if node is None or not path.startswith("/"):
            return best
        for segment in path[1:].split("/"):
            for n in node.get(("lengths",), ()):
                if n <= len(segment) and (found := node[("ends",)].get(segment[:n])):
                    best = found
                    break
            node = node.get(("/", segment))
            if node is None:
                break
        return best


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule (null: none fits) and verdict (the rule's, else ``default``).

    A rule fits its host and all subdomains if the path starts with the rule's path; longest match
    wins, whichever list it is on; block wins between equal rules. The trie is broadcast; of more
    than MAX_RULES rules a join gives the same. Null URLs have an empty host and path. Rows are
    judged one by one, so repeated rows give repeated results and an empty table an empty one; other
    columns are ignored. A very long URL costs a step a segment.
    """
    spark = pages.sparkSession
    if len(rules) > MAX_RULES:
        return judge_urls_by_join(pages, spark.createDataFrame(rules, "rule string, verdict string"), id, url, default)
    shared = spark.sparkContext.broadcast(UrlTrie(rules))
    rows = pages.select(pages[id].alias("page_id"), pages[url].cast("string").alias("url"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            found = [trie.match(h, p) for h, p in parts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([f and f[0] for f in found], pa.string()), pa.array([f[1] if f else default for f in found], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return rows.mapInArrow(judge, f"page_id {rows.schema[0].dataType.simpleString()}, host string, path string, rule string, verdict string")


def judge_urls_by_join(pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """What ``judge_urls`` gives, for a table of rules (rule, verdict) of any size.

    Each distinct host and path offers its host's suffixes; for those that have rules, it offers the
    path's beginnings of the lengths that occur there, and meets the rules by equality.
    """
    at = F.instr("rule", "/")
    known = rules.select(
        F.translate(F.when(at > 0, F.substr("rule", F.lit(1), at - 1)).otherwise(F.col("rule")), string.ascii_uppercase, string.ascii_lowercase).alias("rh"),
        F.when(at > 0, F.substr("rule", at)).otherwise("").alias("rp"),
        F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise(F.raise_error(F.lit("neither allow nor block"))).alias("verdict"),
        "rule",
    )
    lengths = known.groupBy("rh").agg(F.collect_set(F.length("rp")).alias("lengths"))
    text = F.coalesce(pages[url].cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(text, "(?s)^.*?://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    rows = pages.select(pages[id].alias("page_id"), host.alias("host"), F.regexp_extract(text, "(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"))
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct((F.size(labels) - i).alias("depth"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("rh")))
    asked = rows.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("s")).select("host", "path", "s.*").join(lengths, "rh")
    asked = asked.select("host", "path", "rh", "depth", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("path")).withColumn("rp", F.substr("path", F.lit(1), F.col("n")))
    best = asked.join(known, ["rh", "rp"]).groupBy("host", "path").agg(F.max(F.struct("depth", "n", "verdict", "rule")).alias("b"))  # "block" is the greater word
    found = rows.join(best, ["host", "path"], "left")
    return found.select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
