"""Summaries and keywords of whole texts: what :mod:`ranking` says in columns, in Python workers and with less work.

A column function tests every sentence and every phrase of a text, some twenty
patterns each, and takes the best of what is left.  Here they stand in the order of
their scores first and are tested in that order until one passes, so that few are
tested at all.  Texts are read whole, for keywords if the caller says so, and the
results are the same.

The patterns of a rule pack are Java's.  Those of which Python makes the same, which
:func:`portable` tells, are used here; for a pack with others the column functions do
the work.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from folioforge.config import NEUTRAL, RulePack
from folioforge.functions import text as T
from folioforge.operators import ranking
from folioforge.session import ship

#: What both engines read alike, where no line ends: letters, escapes, classes without nesting, groups, anchors, counts.
_ALIKE = re.compile(r"(?:\(\?i\))?(?:[^\\\[\](){}*+?.^$|]|\\[bsdw.|+*?()]|\[\^?(?:[^\\\[\]&^]|\\[sdw.\-|])+\]|\((?!\?)|\(\?(?::|<?[!=])|[)|^$]|[*+?](?!\+)|\{\d+(?:,\d*)?\}(?!\+))*")
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_END = re.compile("[.!?。！？] ")
_HANGUL = re.compile("[가-힣]")
_WORDS, _VOWEL = re.compile("[A-Za-z]{3,}"), re.compile("[aeiouAEIOU]")
_TOKENS, _PLAIN = re.compile("[A-Za-z가-힣0-9]+"), re.compile("[A-Za-z가-힣0-9 .,;:!?()\\-]+")
_RUNS, _OTHERS = re.compile(r"[\|`~^_=]{2,}"), re.compile("[^A-Za-z0-9_가-힣 .,;:!?()\\-]{4,}")
_NO_KEY, _NO_KEY_BYTES = re.compile("[^a-z0-9가-힣]+"), bytes(b for b in range(128) if chr(b) not in "abcdefghijklmnopqrstuvwxyz0123456789")
_PAGES, _PHRASES = re.compile(r"PAGE\s+\d+", re.I | re.A), re.compile(r"[A-Za-z][A-Za-z0-9\- ]{2,40}")


def _used(rules: RulePack) -> tuple[str, ...]:
    return (*rules.boilerplate, rules.summary_words, rules.structure_words, rules.keyword_noise, rules.keyword_positive)


@lru_cache(16)
def portable(rules: RulePack) -> bool:
    """Python reads the patterns that are used here as Java does."""
    return all(_ALIKE.fullmatch(p) for p in _used(rules))


@lru_cache(1)
def _letters() -> str:
    """The inside of a class: what Java 17 takes for a part of a word beside a word boundary."""
    inside, out, start = False, [], 0
    for k in range(0x110000):
        now = unicodedata.category(chr(k)) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd", "Mn") or k == 95
        if now and not inside:
            start = k
        elif inside and not now:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(k - 1))}")
        inside = now
    return "".join(out)


def _needed(parsed) -> tuple[str, ...]:
    """Strings in lower case of which a match holds one at least; none if there is no such list."""
    lists, run = [], ""
    for op, value in [*parsed, (None, None)]:
        if op is _parser.LITERAL and (value < 128 or _HANGUL.match(chr(value))):
            run += chr(value).lower()
            continue
        lists, run = lists + [(run,)] * (run != ""), ""
        if op is _parser.SUBPATTERN:
            lists.append(_needed(value[3]))
        elif op is _parser.BRANCH:
            each = [_needed(x) for x in value[1]]
            lists.append(tuple(w for x in each for w in x) if all(each) else ())
    return max(lists, key=lambda x: min(map(len, x), default=0), default=())


class Pattern:
    """A Java pattern.  ``narrow``: only ASCII letters make words, as since Java 19."""

    def __init__(self, java: str, narrow: bool):
        body = java.removeprefix("(?i)")
        self.java, self.flags, self.narrow = body, re.A | (re.I if body != java else 0), narrow
        self.ascii, self.wide = re.compile(body, self.flags), None
        self.needed = _needed(_parser.parse(body))

    def found(self, s: str, low: str) -> bool:
        """In a sentence or phrase, of which ``low`` is the lower case."""
        if not self.possible(low):
            return False
        if self.narrow or r"\b" not in self.java or s.isascii():
            return self.ascii.search(s) is not None
        if self.wide is None:
            w = _letters()
            self.wide = re.compile(self.java.replace(r"\b", f"(?:(?<=[{w}])(?![{w}])|(?<![{w}])(?=[{w}]))"), self.flags)
        return self.wide.search(s) is not None

    def possible(self, low: str) -> bool:
        """A part of a text of this lower case may match."""
        return not self.needed or any(w in low for w in self.needed)


@lru_cache(64)
def _pattern(java: str, narrow: bool) -> Pattern:
    return Pattern(java, narrow)


def collapse(s: str) -> str:
    """As :func:`T.collapse`: Python's own split takes four signs more for white space."""
    if "\x1c" in s or "\x1d" in s or "\x1e" in s or "\x1f" in s:
        return _SPACES.sub(" ", s).strip(" ")
    return " ".join(s.split())


def sentences(s: str) -> list[str]:
    """Of a collapsed text."""
    out, at = [], 0
    for m in _END.finditer(s):
        out.append(s[at : m.end() - 1])
        at = m.end()
    return [*out, s[at:]] if at < len(s) else out


def garbled(s: str) -> bool:
    words = _WORDS.findall(s)
    n = len(words)
    return n >= 3 and (sum(not _VOWEL.search(w) for w in words) / n >= 0.4 or sum(len(w) == 3 for w in words) / n >= 0.7)


def _word_sign(c: str) -> bool:
    """Java's ``\\w`` under ``(?U)``, beyond ASCII."""
    return unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Mc", "Me", "Nd", "Pc") or c in "\u200c\u200d" or "Ⓐ" <= c <= "ⓩ" or "\U0001f130" <= c <= "\U0001f149" or "\U0001f150" <= c <= "\U0001f169" or "\U0001f170" <= c <= "\U0001f189"


def noise(s: str) -> bool:
    """Of a sentence of a collapsed text."""
    if not s or _RUNS.search(s):
        return True
    for run in _OTHERS.findall(s):
        if re.search("x{4}", "".join("x" if c.isascii() or not _word_sign(c) else "w" for c in run)):
            return True
    tokens = _TOKENS.findall(s)
    return sum(map(len, tokens)) < 10 or len(_PLAIN.sub("", s)) / len(s) >= 0.2 or sum(len(t) <= 2 for t in tokens) / len(tokens) >= 0.5


def _key(low: str) -> bytes:
    return low.encode().translate(None, _NO_KEY_BYTES) if low.isascii() else _NO_KEY.sub("", low).encode()


class Sentences:
    """The sentences of a text that may stand in a summary, tested as they are asked for."""

    def __init__(self, text: str, boilerplate: list[Pattern], words: Pattern, structure: Pattern):
        self.all, low = sentences(text), text.lower()
        self.boilerplate = [p for p in boilerplate if p.possible(low)]
        self.words, self.structure = (p if p.possible(low) else None for p in (words, structure))
        self.low = [s.lower() for s in self.all]
        self.tested: dict[int, bool] = {}
        self.keys: dict[bytes, list[int]] = {}
        self.first: dict[bytes, int] = {}

    def good(self, i: int) -> bool:
        if i not in self.tested:
            s = self.all[i]
            self.tested[i] = not (len(s) < 8 or any(p.found(s, self.low[i]) for p in self.boilerplate) or garbled(s) or noise(s))
        return self.tested[i]

    def hangul(self) -> bool:
        return any(_HANGUL.search(s) and self.good(i) for i, s in enumerate(self.all))

    def first_of_key(self, i: int) -> bool:
        """No good sentence before this good one has its letters and digits."""
        if not self.keys:
            for j, s in enumerate(self.low):
                self.keys.setdefault(_key(s), []).append(j)
        k = _key(self.low[i])
        if k not in self.first:
            self.first[k] = next(j for j in self.keys[k] if self.good(j))
        return self.first[k] == i

    def best(self, target: int, prefer: bool) -> str:
        """As :func:`ranking.best_sentence`: a good sentence has ten letters or digits, so that its key is never empty."""

        def score(i: int) -> tuple[int, ...]:
            s = self.all[i]
            n, low = len(s), self.low[i]
            words = (2 if self.words and self.words.found(s, low) else 0) + (3 if prefer and _HANGUL.search(s) else 0)
            return words, 1 if self.structure and self.structure.found(s, low) else 0, max(0, 40 - abs(n - target)), min(n, 80), -i

        for *_, i in sorted(map(score, range(len(self.all))), reverse=True):
            if self.good(-i) and self.first_of_key(-i):
                return self.all[-i]
        return ""


def _first_sentence(s: str) -> str:
    m = _END.search(s)
    return s[: m.end() - 1] if m else s


def summarise(text: str, name: str, stem: str, patterns: tuple, limit: int, least: int) -> str:
    """As :func:`ranking.normal_summary` without a given one; ``stem``: what a text without a good sentence is called."""
    told = Sentences(collapse(text), *patterns)
    prefer = bool(_HANGUL.search(name)) or (bool(_HANGUL.search(text)) and told.hangul())
    first = _first_sentence(told.best(max(30, limit - 6), prefer) or stem)
    if len(first) < least:
        extra = told.best(limit, prefer)
        if extra and extra != first:
            first = _first_sentence(f"{first} {extra}")
    cut = first[:limit].rstrip(" ") if len(first) > limit else first
    s = (cut or "No summary").rstrip(" .!?。！？,;:")
    return (s[: limit - 1].rstrip(" ") if len(s) >= limit else s) + "."


def phrase(source: str, noise_words: Pattern, positive: Pattern, rules: RulePack) -> str:
    """As :func:`ranking.keyword`, of name and text in one."""
    counts = Counter(" ".join(t.split()) for t in _PHRASES.findall(_PAGES.sub(" ", source)))
    found = list(counts)
    some = positive.possible("\n".join(found).lower())

    def bad(t: str) -> bool:
        low = t.lower()
        words = re.findall("[a-z]+", low)
        return sum(map(len, words)) < 3 or t.count(" ") > 5 or low in rules.low_value_words or low in rules.company_words or noise_words.found(t, low) or all(w in rules.company_words for w in words)

    ranked = sorted(((2 if some and positive.found(t, t.lower()) else 0, n, len(t), -i) for i, (t, n) in enumerate(counts.items())), reverse=True)
    return next((found[-i] for *_, i in ranked if not bad(found[-i])), "")[:40]


def _strings(values: pa.Array) -> list[str | None]:
    return [None if x is None else x.decode("utf-8", "replace") for x in values.cast(pa.binary()).to_pylist()]


def _narrow() -> Column:
    """How the Java at hand reads word boundaries."""
    return F.lit("aé").rlike(r"a\b")


def summary(text: Column, name: Column, limit: int = 80, least: int = 24, rules: RulePack = NEUTRAL) -> Column:
    """:func:`ranking.normal_summary` of a text for which none is given."""
    if not portable(rules):
        return ranking.normal_summary(F.lit(""), text, name, limit, least, rules)
    ship(SparkSession.active())

    def run(texts: pa.Array, names: pa.Array, stems: pa.Array, narrow: pa.Array) -> pa.Array:
        java = bool(len(narrow)) and narrow[0].as_py()
        patterns = [_pattern(p, java) for p in rules.boilerplate], _pattern(rules.summary_words, java), _pattern(rules.structure_words, java)
        rows = zip(_strings(texts), _strings(names), _strings(stems), strict=True)
        return pa.array([summarise(t or "", n or "", s or "", patterns, limit, least) for t, n, s in rows], pa.string())

    return F.arrow_udf(run, "string")(text, name, T.sanitize(F.regexp_replace(name, r"\.[^.]+$", "")), _narrow())


def keyword(name: Column, text: Column, rules: RulePack = NEUTRAL, chars: int | None = 12000) -> Column:
    """:func:`ranking.keyword`, with the same meaning of ``chars``."""
    if not portable(rules):
        return ranking.keyword(name, text, rules, chars)
    ship(SparkSession.active())

    def run(names: pa.Array, texts: pa.Array, narrow: pa.Array) -> pa.Array:
        java = bool(len(narrow)) and narrow[0].as_py()
        noise_words, positive = _pattern(rules.keyword_noise, java), _pattern(rules.keyword_positive, java)
        rows = zip(_strings(names), _strings(texts), strict=True)
        return pa.array(["" if n is None else phrase(f"{n}\n{(t or '')[:chars]}", noise_words, positive, rules) for n, t in rows], pa.string())

    return F.arrow_udf(run, "string")(name, text, _narrow())
