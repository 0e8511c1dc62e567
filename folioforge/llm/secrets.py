"""Secret scans: fixed patterns, and the guess cost of values that stand where credentials stand."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.batches import ending, only, pieces

#: Kinds in the order in which spans that begin together are listed.
KINDS = ["assign", "access", "hex", "guess"]
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # as [0-9a-f]+ of 24 or more: a run has no earlier match to be taken from
#: Where a value is taken for a credential; after the word "is" only one that is not a plain word.
CONTEXT = re.compile(r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|bearer|auth(?:orization)?|credentials?|(?:api|access|private|signing|account)[_-]?key|client[_-]?secret|connection[_-]?string)["']?\x20{0,3}(?:=>|:=|[:=]|\x20is\x20(?=[^\s]*[0-9!@#$%^&*+/=_]))\x20{0,3}["'`]?([^\s"'`,;<>]{6,})""", re.ASCII | re.IGNORECASE)
#: Every match of ASSIGN, or of CONTEXT, holds one of these in lower case.
ASSIGN_NEEDS = ("passw", "secret", "token", "api_key", "apikey")
CONTEXT_NEEDS = ("pass", "pwd", "secret", "token", "bearer", "auth", "credential", "key", "connection")
#: A value that takes more guesses than ten to this power is a secret.
LOG10_GUESSES = 10.0

#: Words that are guessed first, in that order.
WORDS = """password admin secret welcome login master dragon monkey shadow sunshine princess football baseball letmein
trustno superman batman michael jordan hunter killer soccer hockey ranger daniel robert thomas andrew joshua
jennifer jessica ashley amanda charlie george matthew computer internet service server system network database
default guest user root test demo example sample temp change please hello world summer winter spring autumn
monday friday january october orange banana cookie cheese flower freedom whatever secure access private public
token bearer basic client account company google amazon azure github docker redis mysql postgres oracle
production staging development local host north south east west green black white silver golden purple
love baby angel lucky magic money music happy star blue the and for you not null none true false todo""".split()
#: Rows of the keyboard.
ROWS = ["1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"]
LEET = str.maketrans("@431!05$7", "aaeiiosst")
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")


@functools.cache
def neighbours() -> dict[str, set[str]]:
    """Keys next to each key, in its row and the rows above and below; letters and digits also follow each other."""
    spot = {c: (y, x) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    near = {c: {d for d, (v, u) in spot.items() if d != c and abs(v - y) <= 1 and abs(u - x) <= 1} for c, (y, x) in spot.items()}
    for run in ("abcdefghijklmnopqrstuvwxyz", "0123456789"):
        for a, b in zip(run, run[1:], strict=False):
            near[a].add(b)
            near[b].add(a)
    return near


#: Powers of ten that a date and the beginning of a walk cost, and each further key of a walk.
DATE_COST, WALK_COST, KEY_COST = math.log10(365 * 60), math.log10(47), 0.3
#: Longest unit of a repeat.
UNIT = 4


class Guesser:
    """The guess cost of values, with a ranked list of words, the most likely first."""

    def __init__(self, words: Sequence[str] = WORDS):
        self.ranks = {w.lower(): i for i, w in reversed(list(enumerate(words, 1)))}
        self.longest = max(map(len, self.ranks), default=0)
        self.units: dict[str, float] = {}

    def word(self, value: str) -> float:
        """Cost of one listed word, in any case and with usual substitutions; infinite if it is none."""
        low = value.lower()
        plain = low.translate(LEET)
        rank = self.ranks.get(low) or self.ranks.get(plain)
        if not rank:
            return math.inf
        return math.log10(rank + 1) + 0.5 * (sum(c.isupper() for c in value) + sum(a != b for a, b in zip(low, plain, strict=True)))

    def unit(self, unit: str) -> float:
        """Cost of what a repeat repeats: the least over words and single keys."""
        if unit not in self.units:
            if len(self.units) > 100_000:
                self.units.clear()
            cost = [0.0]
            for j in range(1, len(unit) + 1):
                cost.append(min([cost[j - 1] + 1.0, *(cost[i] + self.word(unit[i:j]) for i in range(j - 2))]))
            self.units[unit] = cost[-1]
        return self.units[unit]

    def log10(self, value: str, enough: float = math.inf) -> float:
        """Guesses that the cheapest segmentation of ``value`` takes, as a power of ten.

        ``cost[j]`` is the least over segments that end at j of the cost before the
        segment and its own.  Segments are a listed word of three letters or more
        (its rank, capitals and substitutions), a date, two or more copies of a
        unit of up to ``UNIT`` characters, three in all at least (the unit's cost
        and the number of copies), a walk of three or more neighbouring keys, and a
        single character by brute force at ten guesses.  Time grows with the length
        alone: of the beginnings of a walk, and of a repeat, only those are kept
        that can still be the best.  Once the cost is sure to exceed ``enough`` the
        least so far is given.
        """
        n, low, near = len(value), value.lower(), neighbours()
        if len(low) != n:  # a letter whose lower case is longer
            low = "".join(c.lower()[:1] for c in value)
        cost = [0.0] * (n + 1)
        dates: dict[int, list[int]] = {}
        walk, walk_best, cheap = 0, math.inf, 0
        period = [0] * (UNIT + 1)  # matches in a row of each width
        begins: list[list[list[int]]] = [[[] for _ in range(w)] for w in range(UNIT + 1)]
        for j in range(1, n + 1):
            if value[j - 1].isdigit() and (m := DATE.match(value, j - 1)):
                dates.setdefault(m.end(), []).append(j - 1)
            best = cost[j - 1] + 1.0
            for i in range(max(0, j - self.longest), j - 2):
                if cost[i] < best and (own := self.word(value[i:j])) + cost[i] < best:
                    best = cost[i] + own
            for i in dates.pop(j, ()):
                best = min(best, cost[i] + DATE_COST)
            walk = walk + 1 if j > 1 and low[j - 1] in near.get(low[j - 2], ()) else 0
            if walk >= 2:
                walk_best = min(walk_best, cost[j - 3] - KEY_COST * (j - 3))
                best = min(best, walk_best + WALK_COST + KEY_COST * (j - 1))
            else:
                walk_best = math.inf
            open_ = walk >= 1
            for w in range(1, UNIT + 1):
                if j <= w or low[j - 1] != low[j - 1 - w]:
                    if period[w]:
                        period[w], begins[w] = 0, [[] for _ in range(w)]
                    continue
                period[w] += 1
                open_ = True
                least = max(2, -(-3 // w))
                if period[w] < (least - 1) * w:
                    continue
                # an earlier beginning that costs no more than a later one never costs more again
                kept, held = [], math.inf
                for i in [*begins[w][j % w], j - least * w]:
                    if (own := cost[i] + math.log10((j - i) // w)) < held:
                        kept.append(i)
                        held = own
                begins[w][j % w] = kept
                best = min(best, held + self.unit(low[j - w : j]))
            cost[j] = best
            if best <= enough:
                cheap = j
            elif not open_ and not dates and j - cheap > max(self.longest, 2 * UNIT, 10):
                return min(cost[cheap + 1 : j + 1])
        return cost[n]


@functools.cache
def guesser() -> Guesser:
    return Guesser()


def find(text: str, threshold: float = LOG10_GUESSES, guess: Guesser | None = None) -> list[tuple[str, int, int]]:
    """Spans of one text as kind, start and end in code points, in order."""
    guess = guess or guesser()
    low = text.lower()
    spans, values = [], set()
    if any(k in low for k in ASSIGN_NEEDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                spans.append(("assign", *m.span()))
                values.add(m.span(2))
    spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    if any(k in low for k in CONTEXT_NEEDS):
        values.update(m.span(1) for m in CONTEXT.finditer(text))
    spans += [("guess", s, e) for s, e in values if guess.log10(text[s:e], threshold) > threshold]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = LOG10_GUESSES, words: Sequence[str] = WORDS) -> DataFrame:
    """``id_col, spans`` for each row; a null or empty text has none.

    Base spans are those of the fixed patterns.  Every value in a credential's
    place, those of the pattern of assignments included, is scored, and is a
    ``guess`` span if its guess cost is above ``threshold``; so a base span can
    hold one.  ``words``: the ranked list that guessing begins with.  Time grows
    with the length of a text and of a value.  Repeated rows and null identifiers
    pass through; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess, kind = Guesser(words), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for b in pieces(whole, "text"):
                spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(t or "", threshold, guess)] for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(spans, kind)], ["id", "spans"])

    given = only(docs, id=id_col, text=text_col)
    return given.mapInArrow(ending(run), f"id {given.schema['id'].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("id", id_col)


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest columns of the result of :func:`scan`."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        id_col,
        *(of(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        of("guess").alias("n_guess"),
    )


def mask(docs: DataFrame, *, text_col: str = "text", threshold: float = LOG10_GUESSES, sign: str = "<secret>") -> DataFrame:
    """``docs`` with every span of a secret in the text replaced by ``sign``; all columns stay, null texts too."""
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text or not (spans := find(text, threshold)):
            return text
        out, end = [], 0
        for _, s, e in spans:
            if s >= end:
                out += [text[end:s], sign]
            end = max(end, e)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, text_col):
                yield b.set_column(at, text_col, pa.array(map(clean, b.column(text_col).to_pylist()), pa.string()))

    return docs.mapInArrow(ending(run), docs.schema)
