"""URL rules in a trie over reversed host labels and path segments.

A rule is (verdict, host, path). It fits its host and every subdomain of it, when the path of the url starts
with the rule's path. Of the rules that fit, the one with the most host labels wins, then the one with the
longest path; the same host and path in both lists is a block. Urls that no rule fits get the default verdict.

Host and path follow the plain form: the host is what stands after the first "://" up to "/", "?", "#" or the
end, with A-Z in lower case; the path goes on up to "?", "#" or the end. A null url, or one without "://", has
an empty host and an empty path, and so gets the default verdict. Repeated rows are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The trie is broadcast, so the list of rules has a proven bound.
MOST_RULES = 1_000_000

VERDICT = StructType([StructField(n, StringType()) for n in ("host", "path", "rule", "verdict")])

_URL = re.compile(r"://([^/?#]*)([^?#]*)")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    found = _URL.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


class Node:
    """labels: next host label to the left. paths: the path trie of the rules that end at this host."""

    __slots__ = ("labels", "paths")

    def __init__(self):
        self.labels: dict[str, Node] = {}
        self.paths: PathNode | None = None


class PathNode:
    """parts: next whole segment, with its slash. tails: rules whose last segment is only begun, by that beginning."""

    __slots__ = ("parts", "rule", "tails")

    def __init__(self):
        self.parts: dict[str, PathNode] = {}
        self.rule: tuple[str, str] | None = None
        self.tails: dict[str, tuple[str, str]] = {}


class Trie:
    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root, n = Node(), 0
        for verdict, host, path in rules:
            n += 1
            if n > MOST_RULES:
                raise ValueError(f"more than {MOST_RULES} rules; the trie would not be safe to broadcast")
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r}")
            self._add(verdict, host.translate(_LOWER), path)

    def _add(self, verdict: str, host: str, path: str) -> None:
        node = self.root
        for label in reversed(host.split(".")):
            node = node.labels.setdefault(label, Node())
        at = node.paths = node.paths or PathNode()
        *whole, tail = path.split("/")
        for part in whole:
            at = at.parts.setdefault(part, PathNode())
        value = (host + path, verdict)
        if tail:
            if tail not in at.tails or at.tails[tail][1] != "block":
                at.tails[tail] = value
        elif at.rule is None or at.rule[1] != "block":
            at.rule = value

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """The winning rule and its verdict. Each host label and path segment is looked up once."""
        hosts, node = [], self.root
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            if node.paths is not None:
                hosts.append(node.paths)
        parts = path.split("/")
        for at in reversed(hosts):
            best = None
            for i, part in enumerate(parts):
                best = at.rule or best
                if at.tails:
                    rest = part if len(at.tails) > len(part) else None
                    begun = (part[:k] for k in range(len(part), 0, -1)) if rest else sorted(at.tails, key=len, reverse=True)
                    best = next((at.tails[b] for b in begun if b in at.tails and part.startswith(b)), best)
                at = at.parts.get(part) if i + 1 < len(parts) else None
                if at is None:
                    break
            if best:
                return best
        return None


def judge(spark: SparkSession, url: Column, rules: Iterable[tuple[str, str, str]], default: str = "allow") -> Column:
    """struct<host, path, rule, verdict> of a url column; rule is null where none fits."""
    shared = spark.sparkContext.broadcast(Trie(rules))

    @F.arrow_udf(VERDICT)
    def verdicts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = shared.value
        for batch in batches:
            rows = []
            for url in batch.to_pylist():
                host, path = split_url(url)
                rule, verdict = trie.longest(host, path) or (None, default)
                rows.append((host, path, rule, verdict))
            yield pa.StructArray.from_arrays(
                [pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=VERDICT.names
            )

    return verdicts(url)


def keep_allowed(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """The rows whose url is allowed, with the columns they came with."""
    return pages.where(judge(pages.sparkSession, F.col(url), rules, default)["verdict"] == "allow")
