"""Personal information in free text: e-mail addresses, phone numbers, identity numbers, street addresses and names.

Method: anchor expansion. One Aho-Corasick automaton finds at-signs, schemes, identifier cues, street words, number starts, forms of
address and cues of names in a single pass over each text. At each of them a small deterministic parser expands to the left and right
and validates the boundaries: at-signs to e-mail addresses, schemes to the authority of an address on the web (whose user part is no
e-mail address), cues and digits to identity, account and phone numbers, street words to postal addresses. Names are expanded from forms of address,
cues and the words that the lexicon holds. Overlaps go to the more specific kind (e-mail, identity number, address, phone, name).

The list of known names is completed from the texts themselves: a capitalised word next to a listed name, in the place of a
given or family name, is evidence for another name, and the words around two-part names tell where a single given name may stand.
The evidence of all rows is counted in Spark into a table of words; how much of it is enough does not depend on the number of rows. Of the words
in small letters only those are kept that also occur with a capital, as no other is ever asked for. While that table has at most LEXICON_WORDS rows the
tasks hold it; beyond, the words of each text are joined to it, hot words by broadcast, and every text comes with the part of the lexicon that it asks for.
Both ways give the same rows.

Defined results: null texts and null array elements stay null and hold nothing; empty texts stay as they are; repeated rows give
their cases once; an empty name list still leaves all other kinds and names after forms of address; extra columns are kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgemill.session import cut, heavy_keys, lookup

#: Evidence that is enough, for any number of rows: once for names and small letters, twice for contexts.
EVIDENCE = {"after": 2, "before": 2}
#: Rows of the lexicon that each task may hold (a few megabytes); a larger one is joined instead.
LEXICON_WORDS = 200_000
FIELDS = ("summary", "title", "entities")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
KINDS = ("email", "id_number", "address", "phone", "name")

# Cues in the languages of the texts.
AT = ["@", "(at)", "[at]", "{at}", " at "]
SCHEMES = ["://"]
ID_CUES = ["ssn", "social security", "dni", "nie", "nif", "nir", "steuer-id", "steuer-idnr", "steuernummer", "passport", "reisepass", "passeport", "pasaporte"]
ID_CUES += ["national id", "tax number", "tax id", "id card", "id-card", "ausweis", "carte d'identité", "insurance number"]
STREETS_AFTER = "street st avenue ave lane road rd drive dr court ct boulevard blvd place square terrace way close crescent".split()
STREETS_BEFORE = "avenue rue calle avenida plaza paseo boulevard chemin place camino carrer via allée impasse".split()
STREETS_JOINED = "straße strasse str. weg gasse allee platz ufer".split()
TITLES = "dr prof mr mrs ms miss mme m mlle monsieur madame herr frau sr sra srta dra don doña señor señora".split()
CUES = {"people:": 1, "owner:": 1}

EMAIL_LEFT = re.compile(r"[A-Za-z0-9](?:[\w.+%\-]*[A-Za-z0-9_+])?\s?$")
EMAIL_RIGHT = re.compile(r"\s?(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.|\s?[(\[{]?\bdot\b[)\]}]?\s?))+[A-Za-z]{2,24}\b", re.I)
END = r"(?![\w]|[-/.]\d)"
PHONE = re.compile(
    r"(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,5}(?:[ .\-/]?\d{2,5}){1,5}|00\d{2}[ .\-]\d{1,4}(?:[ .\-]\d{2,6}){1,4}"
    r"|\(\d{2,5}\)[ ]?\d{3,4}[ .\-]?\d{3,4}|0\d{1,4}/\d{5,9}|0\d{2,4} \d{3,4} \d{3,5}|0\d(?:[ .]\d{2}){4}|\d{3}-\d{3}-\d{4}|\d{3}-\d{4})" + END
)
SSN = re.compile(r"\d{3}-\d{2}-\d{4}" + END)
# Shapes of identity numbers that need no cue: what stands before the first digit, what follows from it on
NINO_LEFT, NINO = re.compile(r"(?<![^\W_])([A-Za-z]{2}) ?$"), re.compile(r"\d{2} ?\d{2} ?\d{2} ?[A-Da-d]\b")
NINO_NEVER = {"BG", "GB", "NK", "KN", "TN", "NT", "ZZ"}
NIE_LEFT, DNI = re.compile(r"(?<![^\W_])([XYZ])[ -]?$"), re.compile(r"(\d{7,8})[ -]?([A-Z])\b")
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
NIR = re.compile(r"[12] ?\d{2} ?\d{2} ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3} ?\d{2}" + END)
TAX_ID = re.compile(r"[1-9]\d ?\d{3} ?\d{3} ?\d{3}" + END)
TAX_NUMBER = re.compile(r"(?:\d{2,3}/\d{3}/\d{5}|\d{3}/\d{4}/\d{4})(?![\w/]|[-.]\d)")
ID_VALUE = re.compile(r"(?:[ .:#]|\bno\b|\bnr\b|\bnumber\b|\bn[º°])*([A-Z]{0,3}\d[\dA-Z]*(?:[ /.\-]\d[\dA-Z]*)*(?: [A-Z]\b)?)", re.I)
AUTHORITY = re.compile(r"[^\s/?#<>\"]*")
IBAN = re.compile(r"\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?![A-Za-z\d])")
CARD = re.compile(r"\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}" + END)
W = r"[A-ZÀ-Þ][\w'’\-]*"
TOWN = rf"(?:,? (?:{W} \d{{4,6}}|\d{{4,6}} {W}(?: {W})?)|, {W}(?: \d{{4,6}})?)"
UNIT = r"(?:,? (?:Apt|Suite|Unit|Flat|Floor|#)\.? ?\w+|, \d{1,2}\.?[ºª°](?: \w\b)?)"
TAIL = rf"{UNIT}?{TOWN}?"
# What follows a street word, and what stands before it: a number, a street word, words, a number
AFTER_LEFT = re.compile(rf"\d{{1,5}}[A-Za-z]? (?:{W} ){{1,3}}")
AFTER_RIGHT = re.compile(rf"\b\.?{TAIL}")
BEFORE_LEFT = re.compile(r"\d{1,4}(?: (?:bis|ter))?,? ")
BEFORE_WORDS = re.compile(rf" (?:(?:de|des|du|la|le|les|d['’]|l['’]) ?)*{W}(?: {W})?{TAIL}")
BEFORE_NUMBER = re.compile(rf" (?:(?:de|del|des|du|la|las|los|el) )*{W}(?: {W})?,? \d{{1,4}}[A-Za-z]?\b{TAIL}")
JOINED_RIGHT = re.compile(rf" \d{{1,4}} ?[a-z]?\b{TAIL}")
JOINED_LEFT = re.compile(W)
BOX_LEFT, BOX_RIGHT = re.compile(r"(?:P\. ?O\. ?|PO )$", re.I), re.compile(rf" \d{{1,6}}\b{TAIL}", re.I)
TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")

FOLLOWS = re.compile(r" ([^\W\d_]+)")
GLUED = re.compile(r"[@._+/\\<:]")


@dataclass
class Lexicon:
    """Names in lower case, and the words that stand before and after names."""

    given: set[str] = field(default_factory=set)
    family: set[str] = field(default_factory=set)
    after: set[str] = field(default_factory=set)
    before: set[str] = field(default_factory=set)
    plain: set[str] = field(default_factory=set)  # seen with a capital and in small letters


def automaton(before: set[str] = frozenset()) -> ahocorasick.Automaton:
    """Anchors of all kinds; ``before`` are learned contexts of names."""
    a = ahocorasick.Automaton()
    anchors: dict[str, set[str]] = {}
    for kind, words in (("at", AT), ("scheme", SCHEMES), ("id", ID_CUES), ("num", list("0123456789+(")), ("after", STREETS_AFTER), ("before", STREETS_BEFORE), ("joined", STREETS_JOINED), ("box", ["box", "postfach"])):
        for w in words:
            anchors.setdefault(w, set()).add(kind)
    for w in [*CUES, *(f"{x} " for x in before)]:
        anchors.setdefault(w, set()).add("cue")
    for w, kinds in anchors.items():
        a.add_word(w, (len(w), kinds))
    a.make_automaton()
    return a


def _low(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _email(text: str, a: int, b: int) -> tuple[int, int] | None:
    """An e-mail address around the at-sign; what stands before it is read to its first character, however long it is."""
    i = a - 1 if a and text[a - 1].isspace() else a
    while i and (text[i - 1].isalnum() or text[i - 1] in "_.+%-"):
        i -= 1
    left = EMAIL_LEFT.search(text, i, a)
    right = EMAIL_RIGHT.match(text, b)
    if not left or not right:
        return None
    if text[a:b].strip() == "at" and " dot " not in right.group().lower():
        return None  # plain words
    return left.start(), right.end()


def _id(text: str, a: int, b: int) -> tuple[int, int] | None:
    if a and text[a - 1].isalnum():
        return None
    if b < len(text) and text[b].isalnum():
        return None
    m = ID_VALUE.match(text, b)
    if m and sum(c.isdigit() for c in m.group(1)) >= 5:
        return m.start(1), m.end(1)
    return None


def _tax_id(digits: str) -> bool:
    """The check digit (ISO 7064, mod 11, 10) of a German tax id, and one digit of the first ten that occurs two or three times."""
    times = sorted(digits[:10].count(c) for c in set(digits[:10]))
    if times[-1] not in (2, 3) or times[-2] > 1:
        return False
    p = 10
    for c in digits[:10]:
        p = ((p + int(c)) % 10 or 10) * 2 % 11
    return (11 - p) % 10 == int(digits[10])


def _identity(text: str, a: int) -> tuple[int, int] | None:
    """An identity number around the first digit at ``a``, by its shape and check digits alone."""
    if a and text[a - 1].isdecimal():
        return None
    start, clear = max(0, a - 4), lambda i: not i or text[i - 1] not in "-/.#_+@"
    if (left := NINO_LEFT.search(text[start:a])) and (m := NINO.match(text, a)):
        letters, i = left.group(1), start + left.start()
        real = letters.isupper() and not set(letters) & set("DFIQUV") and letters[1] != "O" and letters not in NINO_NEVER
        if clear(i) and (letters.upper() == "QQ" or real):  # QQ is the prefix of examples
            return i, m.end()
    if (left := NIE_LEFT.search(text[start:a])) and (m := DNI.match(text, a)) and len(m.group(1)) == 7 and clear(start + left.start()):
        if m.group(2) == DNI_LETTERS[int(str("XYZ".index(left.group(1))) + m.group(1)) % 23]:
            return start + left.start(), m.end()
    if a and text[a - 1].isalnum() or not clear(a):
        return None
    if (m := DNI.match(text, a)) and len(m.group(1)) == 8 and m.group(2) == DNI_LETTERS[int(m.group(1)) % 23]:
        return a, m.end()
    if m := NIR.match(text, a):
        n = m.group().replace(" ", "")
        if 97 - int(n[:-2].replace("2A", "19").replace("2B", "18")) % 97 == int(n[-2:]):
            return a, m.end()
    if (m := TAX_ID.match(text, a)) and _tax_id(m.group().replace(" ", "")) or (m := TAX_NUMBER.match(text, a)):
        return a, m.end()
    return None


def _iban(text: str, a: int) -> tuple[int, int, bool] | None:
    """What has the shape of a bank account around the first digit at ``a`` (two letters before it), and whether its check digits (mod 97) hold."""
    letters = text[max(0, a - 2) : a]
    if len(letters) < 2 or not (letters.isascii() and letters.isalpha() and letters.isupper()) or a > 2 and text[a - 3].isalnum() or not (m := IBAN.match(text, a)):
        return None
    n = m.group().replace(" ", "")
    return a - 2, m.end(), int("".join(str(int(c, 36)) for c in n[2:] + letters + n[:2])) % 97 == 1


def _card(text: str, a: int) -> tuple[int, int] | None:
    """A payment card (Luhn) that begins at ``a``."""
    if a and (text[a - 1].isalnum() or text[a - 1] in "-/.#_+") or not (m := CARD.match(text, a)):
        return None
    digits = [int(c) for c in m.group() if c.isdecimal()]
    good = 13 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
    return (a, m.end()) if good else None


def _number(text: str, a: int) -> tuple[int, int, str] | None:
    if text[a].isdecimal() and (s := _card(text, a) or _identity(text, a)):
        return *s, "id_number"
    if a and (text[a - 1].isalnum() or text[a - 1] in "-/.#_+(" and text[a] != "("):
        return None
    if m := SSN.match(text, a):
        return a, m.end(), "id_number"
    if m := PHONE.match(text, a):
        return a, m.end(), "phone"
    return None


def _words_left(text: str, a: int, n: int) -> list[int]:
    """Where the up to ``n`` words before ``a`` begin, the nearest first."""
    out: list[int] = []
    while a > 0 and text[a - 1] == " " and len(out) < n:
        i = text.rfind(" ", 0, a - 1) + 1
        a = i = max(i, text.rfind("\n", 0, a - 1) + 1)
        out.append(i)
    return out


def _address(text: str, a: int, b: int, kinds: set[str]) -> tuple[int, int] | None:
    """A postal address around a street word, the longest of its forms."""
    found: list[tuple[int, int]] = []
    alone = not (a and text[a - 1].isalnum())
    if "after" in kinds and alone and text[a].isupper() and (right := AFTER_RIGHT.match(text, b)):
        for i in _words_left(text, a, 4)[1:]:
            # the number may be glued to an opening mark
            while i < a and not text[i].isdecimal() and not text[i].isalnum():
                i += 1
            if AFTER_LEFT.fullmatch(text, i, a):
                found.append((i, right.end()))
    if "before" in kinds and alone:
        for i in _words_left(text, a, 2):
            while i < a and not text[i].isalnum():
                i += 1
            if BEFORE_LEFT.fullmatch(text, i, a) and (m := BEFORE_WORDS.match(text, b)):
                found.append((i, m.end()))
        if m := BEFORE_NUMBER.match(text, b):
            found.append((a, m.end()))
    if "joined" in kinds and (m := JOINED_RIGHT.match(text, b)):
        i = a
        while i and (text[i - 1].isalnum() or text[i - 1] in "_'’-"):
            i -= 1
        if i < a and JOINED_LEFT.fullmatch(text, i, a):
            found.append((i, m.end()))
    if "box" in kinds and (m := BOX_RIGHT.match(text, b)):
        if text[a:b].lower() == "postfach":
            found.append((a, m.end()))
        elif left := BOX_LEFT.search(text, max(0, a - 6), a):
            found.append((left.start(), m.end()))
    found = [(i, j) for i, j in found if not (i and text[i - 1].isalnum())]
    if not found:
        return None
    i, j = min(found, key=lambda s: (s[0], -s[1]))
    tail = text[i:j].rstrip()
    # without the full stop of the sentence
    return i, i + len(tail) - (tail.endswith(".") and not re.search(r"\b(?:rd|st|ave|dr|ct|blvd)\.$", tail, re.I))


class Finder:
    """All occurrences in one text, by the anchors of one automaton; the lexicon is that of the task, or comes with the text."""

    def __init__(self, lexicon: Lexicon | None = None) -> None:
        self.lexicon = lexicon or Lexicon()
        self.automaton = automaton(self.lexicon.before)

    def find(self, text: str, whole: bool = False, lexicon: Lexicon | None = None) -> list[tuple[int, int, str]]:
        """start, end, kind in order; ``whole`` for a text that is an entity of its own."""
        low, found, cues, hosts, account = _low(text), [], [0] if whole else [], [], 0
        for end, (size, kinds) in self.automaton.iter(low):
            a, b = end - size + 1, end + 1
            if "scheme" in kinds:
                hosts.append((b, AUTHORITY.match(text, b).end()))
            if "at" in kinds and not (hosts and hosts[-1][0] <= a < hosts[-1][1]) and (s := _email(text, a, b)):
                found.append((*s, "email"))
            if "id" in kinds and (s := _id(text, a, b)):
                found.append((*s, "id_number"))
            if "num" in kinds and a >= account:
                if text[a].isdecimal() and (s := _iban(text, a)):
                    account = s[1]  # no number begins within it, whether its check digits hold or not
                    if s[2]:
                        found.append((s[0], s[1], "id_number"))
                elif n := _number(text, a):
                    found.append(n)
            if kinds & {"after", "before", "joined", "box"} and (s := _address(text, a, b, kinds)):
                found.append((*s, "address"))
            if "cue" in kinds:
                cues.append(b)
        if lexicon is not None:
            self.lexicon = lexicon
            cues += [m.end() for c in lexicon.before for m in re.finditer(re.escape(f"{c} "), low)]
        found = _without_overlaps(found)
        return _without_overlaps(found + [(a, b, "name") for a, b in self.names(text, found, whole, cues)])

    def names(self, text: str, taken: list, whole: bool, cues: list[int]) -> list[tuple[int, int]]:
        """Names around the anchors: words of the lexicon, forms of address, and the word after a cue."""
        words, k = [], 0
        for m in TOKEN.finditer(text):
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            if k == len(taken) or m.end() <= taken[k][0]:
                words.append(m)
        given, family, at, self.chain = self.lexicon.given, self.lexicon.family, set(), (0, 0)
        for i, m in enumerate(words):
            low = m.group().lower()
            if low in given or low in family:
                at |= {i - 2, i - 1, i}  # it may be the first part, or the second one, after an initial or not
            elif low in TITLES:
                at.add(i)
        starts = [m.start() for m in words]
        for b in cues:
            i = bisect_left(starts, b)
            if i < len(words) and not text[b : starts[i]].strip():
                at.add(i)
        out, done = [], 0
        for i in sorted(at):
            if i >= done and (n := self._name_at(text, words, i, whole)):
                out.append((words[i].start(), words[i + n - 1].end()))
                done = i + n
        return out

    def _name_at(self, text: str, words: list, i: int, whole: bool) -> int:
        """How many words from word i on are a name (forms of address count as part of it)."""
        lex, w = self.lexicon, words[i].group()
        low = w.lower()
        glue = text[words[i - 1].end() : words[i].start()] if i else ""
        if glue in ("-", "_", "/", ".") or words[i].end() < len(text) and text[words[i].end()] in "_/" or not w[0].isupper():
            return 0
        caps = lambda k: k < len(words) and words[k].group()[0].isupper()
        gap = lambda k: text[words[k - 1].end() : words[k].start()]
        if low in TITLES and not (len(w) > 2 and w.isupper() and not text.isupper()):
            k = self.chain[1] if self.chain[0] < i < self.chain[1] else i + 1
            while k < len(words) and words[k].group().lower() in TITLES and gap(k) in (". ", " "):
                k += 1
            self.chain = i, k
            if caps(k) and gap(k) in (". ", " ", ".") and len(words[k].group()) > 1 and not (low == "m" and gap(k) != ". "):
                n = k - i + 1
                while caps(i + n) and n < 6 and (gap(i + n) == " " or gap(i + n) == ". " and len(words[i + n - 1].group()) == 1):
                    if len(words[i + n].group()) > 1 and words[i + n].group().lower() in lex.plain:
                        break
                    n += 1
                return n
            return 0
        # given [initial.] family
        k = i + 1
        if caps(k) and gap(k) == " " and len(words[k].group()) == 1 and caps(k + 1) and gap(k + 1) == ". ":
            k += 1
        joined = caps(k) and gap(k) == (". " if k > i + 1 else " ") and len(words[k].group()) > 1
        second = words[k].group().lower() if joined else ""
        if joined:
            if low in lex.given and second in lex.family or low in lex.family and second in lex.given:
                return k - i + 1
            if low in lex.given and second not in lex.plain and second not in TITLES and low not in lex.plain:
                return k - i + 1
            if second in lex.family and low not in lex.plain and self._slot(text, words, i, k, whole):
                return k - i + 1
            if low in lex.given and second not in lex.plain and self._slot(text, words, i, k, whole):
                return k - i + 1
            if low not in lex.plain and second not in lex.plain and self._cued(text, words, i) and self._goes_on(text, words, k):
                return k - i + 1
            if whole and low not in lex.plain and second not in lex.plain and _alone(text, words, i, k):
                return k - i + 1
        # family, given
        if caps(i + 1) and gap(i + 1) == ", ":
            nxt = words[i + 1].group().lower()
            if (low in lex.family or self._slot(text, words, i, i + 1, whole) and low not in lex.plain) and nxt in lex.given:
                return 2
            if low in lex.family and nxt not in lex.plain and self._goes_on(text, words, i + 1):
                return 2
        if low in lex.given and self._goes_on(text, words, i) and (low not in lex.plain or self._slot(text, words, i, i, whole)):
            return 1
        return 0

    def _cued(self, text: str, words: list, i: int) -> bool:
        """A cue or a learned context stands before word i."""
        before = _context(text, words[i].start())
        return any(before.endswith(c) for c in CUES) or before in self.lexicon.before

    def _goes_on(self, text: str, words: list, k: int) -> bool:
        """Nothing follows word k, or punctuation, or a word that follows names."""
        m = FOLLOWS.match(text, words[k].end())
        return not m or m.group(1).lower() in self.lexicon.after

    def _slot(self, text: str, words: list, i: int, k: int, whole: bool) -> bool:
        followed = bool(FOLLOWS.match(text, words[k].end())) and self._goes_on(text, words, k)
        return whole and _alone(text, words, i, k) or self._cued(text, words, i) or followed


def _alone(text: str, words: list, i: int, k: int) -> bool:
    """Words i to k are all that the text holds."""
    return i == 0 and not text[: words[i].start()].strip() and not text[words[k].end() :].strip()


def _context(text: str, a: int) -> str:
    """The two words before ``a``, or one, in small letters."""
    left = _words_left(text, a, 2)
    return text[left[-1] : a - 1].lower() if left else ""


def _without_overlaps(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """In order of their places; of two that overlap, the more specific kind, then the one that begins first, then the longer one."""
    kept: list[tuple[int, int, str]] = []
    for one in sorted(set(found), key=lambda s: (KINDS.index(s[2]), s[0], -s[1])):
        i = bisect_left(kept, one)
        if (i == 0 or kept[i - 1][1] <= one[0]) and (i == len(kept) or one[1] <= kept[i][0]):
            kept.insert(i, one)
    return kept


def evidence(text: str, given: set[str], family: set[str]) -> list[tuple[str, str]]:
    """What one text tells about names: (sort, word)."""
    low, out = _low(text), []
    emails = sorted(e for at in AT for m in re.finditer(re.escape(at), low) if (e := _email(text, m.start(), m.end())))
    words, k = list(TOKEN.finditer(text)), 0
    for m in words:
        while k < len(emails) and emails[k][1] <= m.start():
            k += 1
        if m.group().islower() and (k == len(emails) or m.end() <= emails[k][0]) and not GLUED.search(text, max(0, m.start() - 1), m.start()):
            out.append(("plain", m.group()))
    for i, m in enumerate(words):
        w, low = m.group(), m.group().lower()
        if not w[0].isupper():
            continue
        out.append(("capital", low))
        k = i + 1
        if k + 1 < len(words) and len(words[k].group()) == 1 and text[words[k].end() : words[k + 1].start()] == ". ":
            k += 1
        if k >= len(words) or not words[k].group()[0].isupper() or len(words[k].group()) < 2:
            continue
        gap, second = text[words[k - 1].end() : words[k].start()], words[k].group().lower()
        if gap == ", " and k == i + 1 and low in family:
            out.append(("given", second))
        if gap != (". " if k > i + 1 else " ") or low in TITLES or second in TITLES:
            continue
        if second in family and not text.startswith(", ", words[k].end()):
            out.append(("given", low))
        if low in given:
            out.append(("family", second))
        if low in given and second in family:
            if n := FOLLOWS.match(text, words[k].end()):
                out.append(("after", n.group(1).lower()))
            # what opens the text or a sentence
            for j in reversed(_words_left(text, m.start(), 2)):
                if j == 0 or text[j - 2 : j] in (". ", "! ", "? "):
                    out.append(("before", text[j : m.start() - 1].lower()))
                    break
    return out


def learn(history: DataFrame, name_list: DataFrame) -> DataFrame:
    """sort (given, family, after, before, plain), word: the lexicon. The list is the stated, fixed set of known names; all rows give evidence."""
    listed = name_list.filter("name is not null").select(F.when(F.col("role") == "given", "given").otherwise("family").alias("sort"), F.lower("name").alias("word")).distinct()
    rows = listed.collect()
    given, family = ({r["word"] for r in rows if r["sort"] == s} for s in ("given", "family"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[tuple[str, str], int] = {}
            for text in batch["text"]:
                for e in evidence(text, given, family):
                    out[e] = out.get(e, 0) + 1
            yield pd.DataFrame([(s, w, n) for (s, w), n in out.items()], columns=["sort", "word", "n"])

    texts = history.select(F.explode(F.concat(F.array("title", "summary"), F.coalesce("entities", F.array().cast("array<string>")))).alias("text")).filter("text is not null")
    counts = texts.mapInPandas(run, "sort string, word string, n long").groupBy("sort", "word").agg(F.sum("n").alias("n"))
    least = F.coalesce(F.create_map(*[F.lit(x) for kv in EVIDENCE.items() for x in kv])[F.col("sort")], F.lit(1))
    sorts = counts.filter(F.col("n") >= least).groupBy("word").agg(F.collect_set("sort").alias("sorts"))  # at most six of them
    has = lambda x: F.array_contains("sorts", x)
    plain = has("plain") & has("capital")
    kept = F.filter("sorts", lambda x: F.when(x == "plain", plain).when(x.isin("given", "family"), ~plain).otherwise(x != "capital"))
    return cut(sorts.select(F.explode(kept).alias("sort"), "word").unionByName(listed).distinct(), "lexicon")


def asked_words(text: str) -> set[str]:
    """Every word and context that the finder may look up for one text."""
    out = set()
    for m in TOKEN.finditer(text):
        low = m.group().lower()
        out |= {low, re.split(r"['’\-]", low, maxsplit=1)[0]}
        if m.group()[0].isupper():
            out.add(_context(text, m.start()))
    return out


def with_lexicon(history: DataFrame, words: DataFrame) -> DataFrame:
    """``history`` with ``_lexicon``: the rows of ``words`` that the texts of each row ask for. Hot words and hot (repeated) rows are not shuffled."""
    history = history.withColumn("_row", F.sha2(F.to_json(F.struct(*FIELDS)), 256))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                asked = {w for name in FIELDS for t in _texts(getattr(row, name)) if isinstance(t, str) for w in asked_words(t)}
                rows += [(row.row, w) for w in asked]
            yield pd.DataFrame(rows, columns=["row", "word"])

    distinct = history.select(F.col("_row").alias("row"), *FIELDS).dropDuplicates(["row"])
    asked = cut(distinct.mapInPandas(run, "row string, word string"), "asked")
    known = words.groupBy("word").agg(F.collect_set("sort").alias("sorts"))
    hits = lookup(asked, known, "word", heavy_keys(asked, "word")).filter("sorts is not null")
    per_row = cut(hits.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("word", "sorts")).alias("_lexicon")), "lexicons")
    return lookup(history, per_row, "_row", heavy_keys(history, "_row")).drop("_row")


def lexicon_of(rows) -> Lexicon:
    """From pairs of a word and its sorts."""
    out = Lexicon()
    for word, sorts in rows:
        for sort in sorts:
            getattr(out, sort).add(word)
    return out


def prepared(history: DataFrame, words: DataFrame, bound: int) -> tuple[DataFrame, Lexicon | None]:
    """The rows and the lexicon for all tasks, or rows that bring their own and None, if it has more than ``bound`` rows."""
    if words.count() <= bound:
        return history.withColumn("_lexicon", F.lit(None).cast("array<struct<word:string,sorts:array<string>>>")), lexicon_of((r["word"], [r["sort"]]) for r in words.collect())
    return with_lexicon(history, words), None


def _own(value) -> Lexicon:
    return lexicon_of((x["word"], x["sorts"]) for x in (value if value is not None else ()))


def _texts(value) -> list:
    return list(value) if isinstance(value, (list, tuple)) or hasattr(value, "__array__") else [value]


def redacted(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    for a, b, kind in reversed(found):
        text = text[:a] + PLACEHOLDER[kind] + text[b:]
    return text


def occurrences(history: DataFrame, words: DataFrame, bound: int = LEXICON_WORDS) -> DataFrame:
    """id, field, kind, nth of every occurrence; ``words`` is the lexicon."""
    rows, lexicon = prepared(history.select("id", *FIELDS).filter("id is not null"), words, bound)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(lexicon)
        for batch in batches:
            rows = []
            for i, own, *values in zip(batch["id"], batch["_lexicon"], *(batch[name] for name in FIELDS)):
                own = _own(own) if lexicon is None else None
                for name, value in zip(FIELDS, values):
                    count = {}
                    for text in _texts(value):
                        for _, _, kind in finder.find(text, name == "entities", own) if isinstance(text, str) else ():
                            count[kind] = count.get(kind, 0) + 1
                            rows.append((i, name, kind, count[kind]))
            yield pd.DataFrame(rows, columns=["id", "field", "kind", "nth"])

    return rows.mapInPandas(run, "id string, field string, kind string, nth int").distinct()


def redact(history: DataFrame, words: DataFrame, bound: int = LEXICON_WORDS) -> DataFrame:
    """``history`` with typed placeholders in title, summary and entities, else unchanged; ``words`` is the lexicon."""
    columns = history.columns
    rows, lexicon = prepared(history, words, bound)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(lexicon)
        clean = lambda t, whole, own: redacted(t, finder.find(t, whole, own)) if isinstance(t, str) else None
        for batch in batches:
            own = [_own(x) if lexicon is None else None for x in batch["_lexicon"]]
            batch["title"] = [clean(t, False, o) for t, o in zip(batch["title"], own)]
            batch["summary"] = [clean(t, False, o) for t, o in zip(batch["summary"], own)]
            batch["entities"] = [None if e is None else [clean(t, True, o) for t in e] for e, o in zip(batch["entities"], own)]
            yield batch[columns]

    return rows.mapInPandas(run, history.schema)
