"""URL filters: a trie over reversed host labels and then path segments decides by the longest matching entry."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries beyond this many characters in all are refused: the trie goes to every executor.
MAX_RULE_CHARS = 64_000_000
_AUTHORITY = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_UPPER = {c: c + 32 for c in range(65, 91)}
_SEGMENT = re.compile(r"[^/]*/|[^/]+")


@dataclass(frozen=True)
class Rule:
    """One entry: verdict ("allow" or "block"), host and path; it fits the host and all its subdomains if a url's path starts with path."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a url; ("", "") for null or a text without "://"."""
    m = _AUTHORITY.search(url or "")
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nested dicts: labels from the last to the first, then under "/" whole segments; "=" holds an entry, "~" entries that end inside a segment.

    Of two entries with the same host and path the block entry stands.
    """
    root: dict = {}
    for r in sorted(rules, key=lambda r: r.verdict != "block"):
        node = root
        for label in reversed(r.host.translate(_UPPER).split(".")) if r.host else ():
            node = node.setdefault("." + label, {})
        node = node.setdefault("/", {})
        for part in _SEGMENT.findall(r.path):
            if part.endswith("/"):
                node = node.setdefault(part, {})
            else:
                node = node.setdefault("~", {}).setdefault(part, {})
        node.setdefault("=", (r.name, r.verdict))
    return root


def match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The entry with the longest host that fits, and of these the longest path; None if none fits."""
    node, best = trie, None
    chain = [trie] if "/" in trie else []
    for label in reversed(host.split(".")) if host else ():
        node = node.get("." + label)
        if node is None:
            break
        if "/" in node:
            chain.append(node)
    for node in reversed(chain):
        here = node["/"]
        best = here.get("=")
        for part in _SEGMENT.findall(path):
            inside = here.get("~")
            if inside:
                fits = [p for p in inside if part.startswith(p)]
                if fits:
                    best = inside[max(fits, key=len)]["="]
            here = here.get(part)
            if here is None:
                break
            best = here.get("=", best)
        if best:
            return best
    return None


def filter_urls(pages: DataFrame, rules: Iterable[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every url: rows (id, host, path, rule, verdict).

    The trie is broadcast; its size is checked against MAX_RULE_CHARS. A url that no entry fits gets a null rule and the default verdict.
    Null urls and texts without "://" have an empty host and path. Repeated rows are judged each; an empty table gives an empty one.
    """
    rules = list(rules)
    if sum(len(r.name) for r in rules) > MAX_RULE_CHARS:
        raise ValueError("too many url entries to broadcast; join them by host instead")
    spark = pages.sparkSession
    shipped = spark.sparkContext.broadcast(build_trie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shipped.value
        for b in batches:
            hosts, paths, names, verdicts = [], [], [], []
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                name, verdict = match(trie, host, path) or (None, default)
                hosts.append(host)
                paths.append(path)
                names.append(name)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts))], ["id", "host", "path", "rule", "verdict"])

    kind = dict(pages.dtypes)[id_col]
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
