"""Judge urls by host and path rules, then by a weighted vocabulary.

One pass of an Aho-Corasick automaton finds all terms of a url; a hit counts only where
the characters around it are no letters or digits. A url is blocked on one strict term or on
several distinct soft ones. A rule for its host and path overrides that.

Defined results: the vocabulary is looked for in all of the url behind ``://``, query and fragment included, or in
the whole url where that is missing. Such urls have empty host and path. A null url has no hit and is allowed. Repeated rows are judged row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import UPPER

#: Rule (host/path) -> verdict, and the vocabulary.
RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}
STRICT = ("casino", "casinos", "porn", "porno", "xxx", "viagra", "cialis", "escort", "escorts",
          "spam", "warez", "hentai")
SOFT = ("adult", "ads", "bet", "bets", "betting", "cheap", "free", "loan", "loans", "pill",
        "pills", "poker", "prize", "sex", "sexy", "slots", "track", "tracker", "win", "winner", "x")
SOFT_NEEDED = 2

SCHEMA = ("page_id long, host string, path string, rule string, verdict string, "
          "n_strict long, n_soft long")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = {a: b for a, b in enumerate(UPPER) if a != b}


def automaton(strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT):
    out = ahocorasick.Automaton()
    for term in (*strict, *soft):
        out.add_word(term, (term, term in strict))
    out.make_automaton()
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end].translate(_LOWER), rest[end:]
    cut = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host, tail[:cut]


def scanned(url: str | None) -> str:
    """What the vocabulary is looked for in, A-Z lower-cased."""
    return (url or "").partition("://")[2 if "://" in (url or "") else 0].translate(_LOWER)


def rules_by_host(rules: dict[str, str]) -> dict[str, list[tuple[str, str]]]:
    """Per host of a rule (path start, rule), so that a url asks for its own host and its parents only."""
    out: dict[str, list[tuple[str, str]]] = {}
    for rule in rules:
        name, _, start = rule.partition("/")
        out.setdefault(name, []).append(("/" + start, rule))
    return out


def fitting_rule(host: str, path: str, by_host: dict[str, list[tuple[str, str]]]) -> str | None:
    """The longest rule whose host is this host or a parent of it, and whose path begins this."""
    fits, name = [], host
    while True:
        fits += [rule for start, rule in by_host.get(name, ()) if path.startswith(start)]
        _, dot, name = name.partition(".")
        if not dot:
            return max(fits, key=len, default=None)


def hits(terms, text: str) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms of a lower-cased text, at word boundaries only."""
    found: tuple[set[str], set[str]] = (set(), set())
    for end, (term, is_strict) in terms.iter(text):
        begin = end - len(term)
        if (begin < 0 or text[begin] not in _WORD) and (
                end + 1 == len(text) or text[end + 1] not in _WORD):
            found[0 if is_strict else 1].add(term)
    return found


def judge(pages: DataFrame, rules: dict[str, str] | None = None,
          strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT,
          soft_needed: int = SOFT_NEEDED) -> DataFrame:
    """One row per page: host, path, the rule that fits, the verdict, and the hits' numbers."""
    rules = RULES if rules is None else rules

    def run(batches):
        terms, by_host = automaton(strict, soft), rules_by_host(rules)
        for batch in batches:
            rows = []
            for page, url in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist()):
                host, path = split_url(url)
                rule = fitting_rule(host, path, by_host)
                hard, weak = hits(terms, scanned(url))
                bad = bool(hard) or len(weak) >= soft_needed
                rows.append((page, host, path, rule, rules[rule] if rule else
                             "block" if bad else "allow", len(hard), len(weak)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64()])],
                ["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    return pages.select("page_id", "url").mapInArrow(run, SCHEMA)
