r"""URL verdicts from pattern rules indexed by their rarest literal token.

A rule ``(verdict, host, path)`` fits its host, all subdomains, and every path that starts with its
path. As a pattern it is one regular expression over host + path. Each rule is filed under one literal
token that any URL it fits must contain whole: the one seen least often in the table's own URLs
(counted over all of them). A URL's tokens fetch candidate rules; only those run their expressions. Of
the rules that fit, the longest text wins, then the longer host, then ``block``. A rule without any
whole token is a candidate for every URL.

Edge cases: a null URL or one without ``://`` has an empty host and path, fits no rule and gets
``default``; repeated rows repeat; other columns are dropped; an empty table gives an empty result. The
rule index is a broadcast variable; more than ``MAX_RULE_CHARS`` characters of rules are refused.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import map_texts

MAX_RULE_CHARS = 32_000_000
_TOKEN = re.compile(r"[^\W_]+")
_SPLIT = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    found = _SPLIT.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


class RuleIndex:
    def __init__(self, rules: Iterable[tuple[str, str, str]], counts: dict[str, int]):
        self.rules = [(v, h.translate(_LOWER), p) for v, h, p in rules]
        self.by_token: dict[str, list[int]] = defaultdict(list)
        self.always: list[int] = []
        self.patterns = [re.compile(r"(?:[^/]*\.)?" + re.escape(h + p), re.DOTALL) for _, h, p in self.rules]
        self.order = [(len(h) + len(p), len(h), v == "block", -k) for k, (v, h, p) in enumerate(self.rules)]
        for k, (_, host, path) in enumerate(self.rules):
            whole = literal_tokens(host, path)
            if whole:
                self.by_token[min(whole, key=lambda t: (counts.get(t, 0), t))].append(k)
            else:
                self.always.append(k)

    def match(self, host: str, path: str) -> int | None:
        text = host + path
        candidates = set(self.always)
        for token in set(_TOKEN.findall(text)) & self.by_token.keys():
            candidates.update(self.by_token[token])
        # a rule with an empty path must still end with the host
        fits = [k for k in candidates if (m := self.patterns[k].match(text)) and (self.rules[k][2] or m.end() == len(host))]
        return max(fits, key=self.order.__getitem__, default=None)


def literal_tokens(host: str, path: str) -> set[str]:
    """Tokens that stand whole in any URL the rule fits: not one that the URL could go on from."""
    text = host + path
    return {m[0] for m in _TOKEN.finditer(text) if m.end() < len(text) or not path}


def token_counts_of(pages: DataFrame, url_col: str, wanted: set[str]) -> dict[str, int]:
    """How many URLs hold each wanted token, over the whole table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                host, path = split_url(url)
                total.update(wanted.intersection(_TOKEN.findall(host + path)))
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    rows = pages.select(url_col).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}  # one row for each token of the rules at most


def url_verdicts(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow",
                 id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id, host, path, rule, verdict`` per row."""
    rules = list(rules)
    if sum(len(h) + len(p) for _, h, p in rules) > MAX_RULE_CHARS:
        raise ValueError("the rule list is too large to hand to every task")
    wanted = set().union(*(literal_tokens(h.translate(_LOWER), p) for _, h, p in rules))
    shared = pages.sparkSession.sparkContext.broadcast(RuleIndex(rules, token_counts_of(pages, url_col, wanted)))

    def run(urls: list[str | None]) -> dict[str, list]:
        index = shared.value
        out: dict[str, list] = {"host": [], "path": [], "rule": [], "verdict": []}
        for url in urls:
            host, path = split_url(url)
            k = index.match(host, path)
            verdict, rule = (index.rules[k][0], index.rules[k][1] + index.rules[k][2]) if k is not None else (default, None)
            for name, value in zip(out, (host, path, rule, verdict)):
                out[name].append(value)
        return out

    return map_texts(pages, id_col, url_col, "host string, path string, rule string, verdict string", run)
