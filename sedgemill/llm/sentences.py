"""Sentence units of documents in nine languages and seven scripts.

Method: structure (blank lines, fenced blocks, list and role marks) gives hard limits; within them every terminator gives a
candidate boundary, which a maximum-entropy classifier accepts or refuses by its neighbouring tokens, their case, length, digits
and script. It is trained on reliable boundaries only: a terminator at the end of a block is one, a terminator before a small
letter or a comma, or after a token that is never seen at the end of a block (counted over all documents), is none. A blank between two
Thai letters is a candidate too, reliable by whether a conjunction follows.

1. ``candidates``: all documents -> counts of all candidates by token type, features of a share of them with what is sure about each;
2. ``silent_types``: token types that never end a block, from counts over all candidates, in a filter of fixed size;
3. ``train``: weights from at most SAMPLE labelled candidates, the first ones in the order of a hash, a quarter of them at most Thai blanks;
4. ``sentence_units``: all documents -> units.

Defined results: null and blank texts have no units; a text without any terminator is one unit per block; repeated rows give
their units once; very long texts are read line by line and block by block; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgemill.session import cut, spread

#: Labelled candidates that the classifier is fitted on, at most.
SAMPLE = 40_000
#: Size of the hashed feature space.
SPACE = 1 << 16
#: A token type is silent if it has at least this many candidates, for any number of documents, and hardly ever ends a block.
SILENT_LEAST, SILENT_RATE = 25, 0.004
#: Places of the filter of silent types, whatever their number: 2 MB at most, and one type in a hundred meets another at 160,000 of them.
SILENT_PLACES = 1 << 24

# Marks, and abbreviations by what may follow them.
TERMINATORS = ".!?…。！？｡।॥؟۔"
OPENERS = {"(": ")", "[": "]", "（": "）", "【": "】", "«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "‹": "›"}
CLOSERS = ")]）】»”“」』›\""
TITLES = "dr prof mr mrs ms mme m mlle sr sra srta dra herr st rev gen col lt capt hr fr ing د أ م डॉ श्री".split()
BEFORE_NUMBER = "no nr nº n fig figs abb art abs p pp pág págs s vol ch sec jan feb mar apr jun jul aug sep sept oct nov dec ص vgl cf".split()
INNER = "e.g i.e vs approx bzw z b d h u a inkl vgl cf ca p ex al dept inc ltd u.k u.s ee".split()
THAI_JOINS = ("และ", "แต่", "หรือ", "เพราะ", "เนื่องจาก", "จึง", "ซึ่ง", "โดย", "ดังนั้น", "เพื่อ")

MARK = re.compile(r"[ \t]*(?:(?:[A-Z][A-Z_ ]{1,19}|User|Assistant|System|Human|Tool)[ \t]*[:：]|\d{1,9}[.)](?=[ \t]|$)|[-*+•‣](?=[ \t])|>|#{1,6}(?=[ \t]))")
FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|$)")
RUN = re.compile("[" + re.escape(TERMINATORS) + "]+")
THAI_GAP = re.compile(r"(?<=[ก-ฺเ-๎])[  ]+(?=[ก-ฺเ-๎])")
CLOSING = re.compile("[" + re.escape(CLOSERS) + " \u00a0\u202f]*")
ENCLOSING = re.compile("[" + re.escape("".join([*OPENERS, *CLOSERS])) + "]")
DIGITS = re.compile(r"\d+")
BLANK = re.compile(r"\s")
NOT_BLANK = re.compile(r"\S")
MARKS_BEFORE = re.compile(r"[(\"'“„«‘\[（「¿¡*_]*")
#: What features read of a token: at most so many characters or runs of digits from its start, and two from its end.
HEAD = re.compile(r"[(\"'“„«‘\[（「¿¡]*(?:\d+|[^\s\d]){0,24}")


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """start, end, is_code of each stretch of text that no sentence crosses."""
    start, fence, at = None, None, 0
    while at < len(text):
        m = LINE.match(text, at)
        line, end = text[at : m.end()], m.end()
        if fence is not None:
            if line.strip().startswith(fence) and not line.strip().strip(fence[0]):
                yield start, end, True
                start, fence = None, None
        elif f := FENCE.match(line):
            if start is not None:
                yield start, at, False
            start, fence = at, f.group(1)
        elif not line.strip():
            if start is not None:
                yield start, at, False
            start = None
        elif start is None:
            start = at
        elif MARK.match(line):
            yield start, at, False
            start = at
        at = end
    if start is not None:
        yield start, len(text), fence is not None


def pairs(s: str) -> list[tuple[int, int]]:
    """Outermost quotes and brackets that are closed within ``s``: first and last position. Each mark is put on and taken off once."""
    open_: list[int] = []  # places of open marks
    by_mark: dict[str, list[int]] = {}  # for each closing mark, which of them it would close
    done: list[tuple[int, int]] = []

    def opens(i: int, closing: str) -> None:
        by_mark.setdefault(closing, []).append(len(open_))
        open_.append(i)

    def closes(i: int, c: str) -> bool:
        if not by_mark.get(c):
            return False
        k = by_mark[c][-1]
        done.append((open_[k], i))
        del open_[k:]
        for places in by_mark.values():
            while places and places[-1] >= k:
                places.pop()
        return True

    for m in ENCLOSING.finditer(s):
        i, c = m.start(), m.group()
        if c == '"':
            before = s[i - 1] if i else " "
            if by_mark.get(c) and not (before.isspace() and i + 1 < len(s) and not s[i + 1].isspace()):
                closes(i, c)
            elif before.isspace() or not before.isalnum():
                opens(i, c)
        elif not closes(i, c) and c in OPENERS:
            opens(i, OPENERS[c])
    outer: list[tuple[int, int]] = []
    for a, b in sorted(done):
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def script(c: str) -> str:
    o = ord(c) if c else 0
    for name, low, high in (("thai", 0xE00, 0xE7F), ("arabic", 0x600, 0x6FF), ("deva", 0x900, 0x97F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF)):
        if low <= o <= high:
            return name
    return "digit" if c.isdigit() else "latin" if c.isalpha() else "other"


def shape(token: str) -> str:
    if not token:
        return "end"
    c = token[0]
    return "digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.islower() else "plain" if c.isalpha() else "mark"


def plain(token: str) -> str:
    """Lower case, digits as 9, without opening marks and cut to what identifies an unspaced script."""
    t = token.lower()
    if not t.isalpha():
        t = DIGITS.sub("9", t.lstrip("(\"'“„«‘[（「¿¡"))
    return t if len(t) < 4 or ord(t[-1]) < 0x2E80 else t[-2:]


class Ahead:
    """The token after a place of ``s``, wherever it stands and however long it is. Asked in rising order, it passes each token once."""

    def __init__(self, s: str) -> None:
        self.s, self.start, self.end = s, 0, 0

    def at(self, b: int) -> tuple[str, str]:
        """Its first character and the token without marks before it, both empty at the end; of a long one only what features read."""
        m = NOT_BLANK.search(self.s, b)
        if m is None:
            return "", ""
        a = m.start()
        if not self.start <= a < self.end:
            end = BLANK.search(self.s, a)
            self.start, self.end = a, end.start() if end else len(self.s)
        head = MARKS_BEFORE.match(self.s, a, self.end).end()
        if self.end - head <= 64:
            return self.s[a], self.s[head : self.end]
        tail = self.end
        for _ in range(3):
            tail -= 1
            while tail > head and self.s[tail].isdecimal() and self.s[tail - 1].isdecimal():
                tail -= 1
        begin = HEAD.match(self.s, head, self.end).end()
        return self.s[a], self.s[head:begin] + self.s[max(begin, tail) : self.end]


@dataclass(slots=True)
class Candidate:
    end: int  # where the unit would end
    kind: str  # token type that the counts go by, empty for marks that are never part of a token
    sure: bool | None  # what is reliable about it
    last: bool  # the block ends here
    words: tuple[str, str] = ("", "")  # the two tokens before
    run: str = ""
    tail: str = ""
    pair: str = ""
    opened: str = ""
    nxt: str = ""
    extra: tuple[str, ...] = ()

    def names(self) -> list[str]:
        """Features of the classifier."""
        if not self.run:
            return ["thai", *self.extra]
        _, word = self.words
        mark = "." if self.run[0] == "." else self.run[-1]
        head, follow, kind = shape(self.nxt), plain(self.nxt)[:12], self.kind
        names = ["b", "m" + mark, "n" + head, "w" + word, "f" + follow, "o" + self.opened, "mn" + mark + head, "l" + str(min(len(word), 8)), "s" + script(word[-1:])]
        names += ["pn" + self.pair + self.tail + head, "kn" + kind + "|" + head, "kf" + kind + "|" + follow, "sn" + script(word[-1:]) + mark + head]
        if self.run == ".":
            stem = word.rstrip(".")
            sort = "title" if stem in TITLES else "number" if stem in BEFORE_NUMBER else "inner" if stem in INNER else "initial" if INITIAL.fullmatch(stem) else "word"
            names += ["a" + sort, "an" + sort + head, "d" + str("." in word) + head]
        return [*names, *self.extra]


INITIAL = re.compile(r"[a-z](\.?-[a-z])?")


def _before(s: str, a: int, run: str) -> tuple[str, tuple[str, str]]:
    """Token type and the two tokens before a terminator."""
    window = s[max(0, a - 60) : a]
    tokens = [] if run[0] not in "?!»" and window[-1:].isspace() else window.split()
    word = tokens[-1] if tokens else ""
    before = tokens[-2][-24:] if len(tokens) > 1 and len(word) <= 24 else ""
    before, word = plain(before), plain(word[-24:])
    if run != ".":
        return "", (before, word)
    return (f"{before} {word}" if word.isdigit() or not word[:1].isalnum() else word), (before, word)


def scan(text: str) -> Iterator[tuple[int, int, list[Candidate]]]:
    """Each block with its candidates in order."""
    limits = list(blocks(text))
    for n, (start, stop, code) in enumerate(limits):
        s = text[start:stop].rstrip()
        found: list[Candidate] = []
        if not code:
            lead = m.end() if (m := MARK.match(s)) else 0
            outer, ahead = pairs(s), Ahead(s)
            p = 0
            for m in RUN.finditer(s, lead):
                a, b, run = m.start(), m.end(), m.group()
                while p < len(outer) and outer[p][1] < a:
                    p += 1
                inside = p < len(outer) and outer[p][0] < a
                if not run.strip(".…") and (len(run) > 1 or "…" in run):
                    continue  # dots of omission alone end nothing
                pair = opened = tail = ""
                if inside:
                    x, y = outer[p]
                    if b < y and CLOSING.match(s, b, y).end() < y:
                        continue  # within a quotation or bracket
                    before = x
                    while before > lead and s[before - 1].isspace():
                        before -= 1
                    pair, tail = s[x], s[y]
                    opened = "start" if before <= lead or s[before - 1] in TERMINATORS + CLOSERS else "colon" if s[before - 1] in ":：," else "mid"
                    b = y + 1
                if b < len(s) and not s[b].isspace():
                    if pair or run[-1] not in "。！？｡।॥؟۔" or s[b] in CLOSERS + "，、；：,;:":
                        continue
                last = b >= len(s)
                if last:
                    after = text[limits[n + 1][0] : limits[n + 1][1]] if n + 1 < len(limits) else ""
                    after = after[m2.end() :] if (m2 := MARK.match(after)) else after
                first, nxt = Ahead(after).at(0) if last else ahead.at(b)
                kind, words = _before(s, a, run)
                extra = ("q" + kind,) if first and first in "\"“„«「(（" else ()
                # caseless text goes on after a quotation that began within its sentence
                goes_on = bool(pair) and opened in ("mid", "colon") and shape(nxt) == "plain"
                sure = True if last else None
                if not last and (first in ",;:،؛，" or goes_on or shape(nxt) == "lower" and run[-1] in ".!?"):
                    sure = False
                elif not pair and run[-1] in "。！？｡।॥؟۔":
                    sure = True
                if goes_on and not last:
                    extra += ("goes on",)
                found.append(Candidate(b, kind, sure, last, words, run, tail, pair, opened, nxt, extra))
            q = 0
            for m in THAI_GAP.finditer(s, lead):
                while q < len(outer) and outer[q][1] < m.start():
                    q += 1
                if q == len(outer) or m.start() < outer[q][0]:
                    joined = s.startswith(THAI_JOINS, m.end())
                    found.append(Candidate(m.start(), "", not joined, False, extra=("thai joined" if joined else "thai apart",)))
            found.sort(key=lambda c: c.end)
        yield start, start + len(s), found


@functools.lru_cache(maxsize=1 << 17)
def slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % SPACE


@functools.lru_cache(maxsize=1 << 17)
def place(kind: str) -> int:
    """Where a token type stands in the filter of silent types; ``F.crc32`` gives the same."""
    return zlib.crc32(kind.encode("utf-8", "surrogatepass")) % SILENT_PLACES


def hashed(names: list[str]) -> list[int]:
    return [slot(x) for x in names]


@dataclass
class Model:
    weights: list[float]
    silent: bytes = b""  # one bit for each place

    def is_silent(self, kind: str) -> bool:
        if not self.silent or not kind:
            return False
        k = place(kind)
        return bool(self.silent[k >> 3] >> (k & 7) & 1)

    def accepts(self, c: Candidate) -> bool:
        names = c.names() + ["silent"] * self.is_silent(c.kind)
        w = self.weights
        return sum(w[slot(x)] for x in names) > 0


def units(text: str | None, model: Model) -> list[tuple[int, int]]:
    """Start and end of every unit of one text."""
    out = []
    for start, stop, found in scan(text or ""):
        at = start
        for end in [start + c.end for c in found if c.end < stop - start and model.accepts(c)] + [stop]:
            a, b = at, end
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((a, b))
            at = end
    return out


def candidates(documents: DataFrame, share: float = 1.0) -> DataFrame:
    """Counts of all candidates by token type (kind, n, ends), and of a share of them, by hash, the features (names, sure, last, order_key)."""
    limit = share * 2**32

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, counts = [], {}
            for text in batch["text"]:
                for start, _, found in scan(text):
                    key = zlib.crc32(text[start : start + 200].encode("utf-8", "surrogatepass"))
                    for c in found:
                        n = counts.setdefault(c.kind, [0, 0])
                        n[0] += 1
                        n[1] += c.last
                        order = zlib.crc32(b"%d" % (start + c.end), key)
                        if order < limit:
                            rows.append((c.kind, 0, 0, hashed(c.names()), c.sure, c.last, order))
            rows += [(kind, n, ends, None, None, None, None) for kind, (n, ends) in counts.items()]
            yield pd.DataFrame(rows, columns=["kind", "n", "ends", "names", "sure", "last", "order_key"]).astype({"order_key": "Int64", "sure": "boolean", "last": "boolean"})

    return spread(documents.select("text").filter("text is not null")).mapInPandas(run, "kind string, n long, ends long, names array<int>, sure boolean, last boolean, order_key long")


def silent_types(found: DataFrame) -> DataFrame:
    """kind of the types that hardly ever end a block."""
    counts = found.filter("names is null and kind <> ''").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    return counts.filter((F.col("n") >= SILENT_LEAST) & (F.col("ends") <= SILENT_RATE * F.col("n"))).select("kind")


def silent_filter(kinds: DataFrame) -> bytes:
    """One bit for each of SILENT_PLACES; at most so many numbers, and no words, reach the driver."""
    rows = kinds.select(F.pmod(F.crc32(F.encode("kind", "UTF-8")), F.lit(SILENT_PLACES)).cast("int").alias("k")).distinct().toPandas()
    bits = np.zeros(SILENT_PLACES, np.uint8)
    bits[rows["k"].to_numpy()] = 1
    return np.packbits(bits, bitorder="little").tobytes() if len(rows) else b""


def fit(names: list[np.ndarray], labels: np.ndarray, rounds: int = 60, penalty: float = 1e-5) -> np.ndarray:
    """Weights of a logistic model by full-batch adaptive gradient steps."""
    w, seen = np.zeros(SPACE), np.full(SPACE, 1e-8)
    if not len(labels):
        return w
    row = np.repeat(np.arange(len(names)), [len(x) for x in names])
    col = np.concatenate(names)
    share = np.where(labels > 0, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(names)), -30, 30)))
        g = np.bincount(col, ((p - labels) * share)[row], SPACE) + penalty * w
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    return w


def train(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """The classifier from reliable boundaries; counts over all documents, weights from at most ``sample`` labelled candidates."""
    chars = documents.agg(F.sum(F.length("text"))).first()[0] or 0
    # about one candidate in forty characters; several times the sample, as not all are labelled
    found = cut(candidates(documents, min(1.0, 6 * sample * 40 / max(1, chars))), "candidates")
    silent = silent_filter(silent_types(found))
    model = Model([], silent)
    rows = []
    features = found.filter("names is not null").withColumn("thai", (F.col("kind") == "") & F.array_contains("names", slot("thai")))
    sure = F.col("sure").isNotNull() | ~F.col("last")
    for thai, most in ((True, sample // 4), (False, sample - sample // 4)):
        # twice the share at first: what is unsure about a type that is not silent drops out
        some = features.filter((F.col("thai") == thai) & sure).orderBy("order_key", F.hash("names")).limit(2 * most).select("kind", "names", "sure", "last").collect()
        labelled = [(r, False if model.is_silent(r["kind"]) and not r["last"] else r["sure"]) for r in some]
        rows += [(r, label) for r, label in labelled if label is not None][:most]
    extra = hashed(["silent"])
    names = [np.array(list(r["names"]) + extra * model.is_silent(r["kind"])) for r, _ in rows]
    return Model(fit(names, np.array([float(label) for _, label in rows])).tolist(), silent)


def sentence_units(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, start_char, end_char of every unit; offsets in code points, end excluded."""
    model = model or train(documents)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, a, b) for i, text in zip(batch["doc_id"], batch["text"]) for a, b in units(text, model)]
            yield pd.DataFrame(rows, columns=["doc_id", "start_char", "end_char"])

    texts = documents.select("doc_id", "text").filter("text is not null and doc_id is not null")
    return spread(texts).mapInPandas(run, "doc_id long, start_char int, end_char int")
