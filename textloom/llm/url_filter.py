"""URL allow and block lists as a trie over reversed host labels and path segments.

The rules are a parameter of the caller, compiled once on the driver into nested dicts whose size
is checked; executors read only the url column and walk the trie once per url.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import map_batches

MAX_RULES, MAX_MB = 1_000_000, 256
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ://."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    ends = [i for c in "/?#" if (i := rest.find(c)) >= 0]
    end = min(ends, default=len(rest))
    host, tail = rest[:end].translate(_LOWER), rest[end:]
    if not tail.startswith("/"):
        return host, ""
    return host, tail[: min([i for c in "?#" if (i := tail.find(c)) >= 0], default=len(tail))]


class UrlTrie:
    """Nodes: {"h": label -> node, "p": segment -> node, "t": partial segment -> rule, "r": rule}."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for n, (verdict, rule) in enumerate(rules):
            if n >= MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules: the trie is broadcast")
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault("h", {}).setdefault(label, {})
            *whole, last = (slash + path).split("/")
            for segment in whole:
                node = node.setdefault("p", {}).setdefault(segment, {})
            if last or not whole:
                node = node.setdefault("t", {}).setdefault(last, {})
            # of equal rules, block wins
            if node.get("r", ("",))[0] != "block":
                node["r"] = (verdict, rule)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule of the longest host suffix, then of the longest path prefix, that fits."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get("h", {}).get(label)
            if node is None:
                break
            best = self._path(node, path) or best
        return best

    def _path(self, node: dict, path: str) -> tuple[str, str] | None:
        best, parts = None, path.split("/")
        for i, part in enumerate(parts):
            if tails := node.get("t"):
                for k in range(len(part), -1, -1):
                    if part[:k] in tails:
                        best = tails[part[:k]]["r"]
                        break
            node = node.get("p", {}).get(part) if i < len(parts) - 1 else None
            if node is None:
                break
            best = node.get("r", best)
        return best


def _bounded(trie: UrlTrie) -> UrlTrie:
    size = len(pickle.dumps(trie, 5))
    if size > MAX_MB * 1_000_000:
        raise ValueError(f"a trie of {size} bytes is too large to broadcast")
    return trie


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id_col, host, path, rule (null if none fits), verdict.

    rules are (allow or block, "host/path") pairs; a rule fits its host and all subdomains if the
    url's path starts with the rule's path, and the longest host, then the longest path, wins; of
    one rule in both lists, block wins.  A null url, an empty one or one without :// has empty host
    and path and gets the default verdict.  Repeated pages give repeated rows.
    """
    sent = pages.sparkSession.sparkContext.broadcast(_bounded(UrlTrie(rules)))

    def start():
        trie = sent.value

        def step(columns):
            ids, urls = columns
            parts = [split_url(u) for u in urls]
            found = [trie.find(h, p) for h, p in parts]
            return [ids, [h for h, _ in parts], [p for _, p in parts], [f and f[1] for f in found], [f[0] if f else default for f in found]]

        return step

    src = pages.select(F.col(id_col).cast("long"), F.col(url_col))
    return map_batches(src, start, f"`{id_col}` long, host string, path string, rule string, verdict string")
