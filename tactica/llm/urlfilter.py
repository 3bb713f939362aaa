"""Operator 6: URL rules indexed by their rarest literal token.

A rule fits urls that hold all of its literal tokens: the labels of its host
and the closed segments of its path (followed by a slash, so that a url can't
go on inside them). Each rule is filed under the one of these that fewest urls
of the corpus hold; the tokens of a url fetch the rules filed under them, and
only those run their regular expressions. The longest rule that fits wins.

The rules and the counts of their tokens (a number bounded by the rules) go to
every task; urls are judged where they are read, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules go to every task; more than this is refused.
MAX_RULES = 2_000_000
_upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_place = re.compile(r"([^/?#]*)([^?#]*)")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rule(text: str, verdict: str) -> Rule:
    """``host/path``; the path begins at the first slash."""
    host, slash, rest = text.partition("/")
    return Rule(host.translate(_upper), slash + rest, verdict)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    host, path = _place.match(url[url.index("://") + 3:]).groups()
    return host.translate(_upper), path


def url_tokens(host: str, path: str) -> set[str]:
    """``.label`` for each label of the host, ``/segment`` for each segment of the path."""
    return {"." + x for x in host.split(".") if x} | {"/" + x for x in path.split("/") if x}


def rule_tokens(rule: Rule) -> set[str]:
    """The tokens that every url that the rule fits has."""
    closed = rule.path[:rule.path.rfind("/") + 1]
    return url_tokens(rule.host, closed)


class RuleIndex:
    """``counts``: in how many urls a token of the rules was seen."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.filed: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        self.always: list[tuple[Rule, re.Pattern]] = []
        for rule in rules:
            host = rf"(?:[^/]*\.)?{re.escape(rule.host)}" if rule.host else "[^/]*"
            entry = (rule, re.compile(host + (re.escape(rule.path) if rule.path else r"(?=/|\Z)"), re.DOTALL))
            tokens = rule_tokens(rule)
            if tokens:
                rarest = min(tokens, key=lambda t: (counts.get(t, 0), t))
                self.filed.setdefault(rarest, []).append(entry)
            else:
                self.always.append(entry)

    def best(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits; of equals that with the longer host, then a block."""
        if not host and not path:
            return None
        place = host + path
        fits = [rule for t in url_tokens(host, path) for rule, pattern in self.filed.get(t, ()) if pattern.match(place)]
        fits += [rule for rule, pattern in self.always if pattern.match(place)]
        return max(fits, key=lambda r: (len(r.name), len(r.host), r.verdict == "block"), default=None)


def token_counts(urls: DataFrame, rules: list[Rule], url_col: str = "url") -> dict[str, int]:
    """In how many urls each token of the rules occurs; summed in tasks, then over tasks."""
    wanted = frozenset(t for r in rules for t in rule_tokens(r))

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                counts.update(wanted & url_tokens(*split_url(url)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                         ["token", "n"])

    partial = urls.select(F.col(url_col).cast("string")).mapInArrow(run, "token string, n long")
    return {r["token"]: r["n"] for r in partial.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url_col: str = "url",
               keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: page_id) and host, path, rule, verdict of every row.

    A null url, or one without ``://``, has an empty host and path and takes the
    default verdict with a null rule; so does a url that no rule fits. Repeated
    rows are judged each. Columns outside ``keep`` are left out, so names can't
    clash.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} go to every task")
    index = RuleIndex(rules, token_counts(pages, rules, url_col))
    shared = pages.sparkSession.sparkContext.broadcast(index)
    keep = ["page_id"] if keep is None else keep
    source = pages.select(*keep, F.col(url_col).cast("string").alias("__url"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches):
        index = shared.value
        for batch in batches:
            places = [split_url(u) for u in batch.column(batch.num_columns - 1).to_pylist()]
            best = [index.best(h, p) for h, p in places]
            text = lambda xs: pa.array(list(xs), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], text(h for h, _ in places), text(p for _, p in places),
                 text(r and r.name for r in best), text(r.verdict if r else default for r in best)],
                [*keep, "host", "path", "rule", "verdict"])

    return source.mapInArrow(run, f"{kinds}, host string, path string, rule string, verdict string")
