"""Functions paired with their documentation.

Method: every file that parses in its language becomes a syntax tree; its function nodes are visited at any depth, with exact source
ranges; documentation is the docstring (Python) or the comment right above, with at most annotations, attributes or directives
between; empty, trivial and name-repeating descriptions are dropped.

Defined results: files that do not parse, unknown extensions and null codes give no pairs; a description of tag lines only is
empty; repeated rows give their pairs again in ``documented_functions`` and once in ``documented_names``; functions of one name on one line give one pair; extra columns are ignored.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from sedgemill.llm.syntax import Invalid, Untold, languages, parse_other, parse_python, ranked, without_mark
from sedgemill.session import spread

BREAK = re.compile(r"\r\n|\n|\r")
WORDS, CHARS = 3, 5

# Documentation comments by language, lines that may stand between, words that say nothing.
DOC = {
    "javascript": r"/\*\*(?!/)", "typescript": r"/\*\*(?!/)", "java": r"/\*\*(?!/)", "c": r"/\*\*(?!/)|///", "cpp": r"/\*\*(?!/)|///",
    "rust": r"///(?!/)", "csharp": r"///(?!/)", "go": r"//|/\*", "ruby": r"#",
}
BETWEEN = {
    "javascript": r"@|//\s*(?:eslint|@ts-|prettier|istanbul)|/\*\s*(?:eslint|istanbul)", "typescript": r"@|//\s*(?:eslint|@ts-|prettier|tslint)", "java": r"@",
    "c": r"#\s*\w+|__attribute__|\[\[", "cpp": r"#\s*\w+|__attribute__|\[\[|template\b", "rust": r"#!?\[", "csharp": r"\[|#\s*\w+",
    "go": r"//(?:go|nolint|lint|export|line)\b:?", "ruby": r"#\s*(?:rubocop|frozen_string_literal|typed|steep|sorbet):?|sig\b|private$|public$|protected$|memoize\b",
}
ARTICLES = set("a an the der die das den dem des ein eine einen einem einer le la les l un une du de el los las una o os as um uma".split())
TAG = re.compile(r"^\s*(?:@\w+|:\w+(?:\s[^:\n]*)?:|\\(?:param|return|returns|brief)\b|<(?:param|returns?|exception|typeparam|value|seealso|permission)\b)", re.I)
XML_TAG = re.compile(r"<(/?)(param|returns?|exception|typeparam|value|seealso|permission)\b[^<>]*>", re.I)
MARKUP = re.compile(r"</?(?:summary|remarks|para|c|code|example|list|item|description|see|paramref|p|b|i)\b[^<>]*>|\{@\w+ |\}", re.I)
# Phrases that say only that documentation is missing, still to be written or found elsewhere, one a line: places parted by blanks,
# words of one place by bars; a place that ends in ``?`` may be left out; ``.`` is any word, ``~`` any but a question word, DOC a word for documentation.
NOTHING = """
todo|fixme|tbd|tba|xxx|wip|hack|n/a|none|nil|null|undocumented|placeholder|self-explanatory|inheritdoc|pendiente
self explanatory
no DOC yet|available|provided|here?
missing|need|needs|lack|lacks|add|write|insert a|an|the|some|more|proper|real|this|function|method? DOC here|later|me|please?
fill in a|an|the|some|this? DOC? here|later?
document|documentation this|me|it function|method|later|soon|properly|please?
DOC is|are? still? missing|pending|needed|later|soon|tbd|todo|follows|here|incomplete|absent ~?
DOC to follow|come|do
DOC to be written|added|done|provided ~?
DOC goes|go|comes here
DOC will|coming follow|come|soon|be? ~? ~?
to be documented|written|done|described|added ~?
not yet? documented yet?
see also? the|a? ~ .? .? .? .?
as above
same as ~ .?
inherit|inherited|inherits DOC? from? .?
override|overrides|overridden|overriding ~?
siehe|vgl|voir|ver ~ .? .?
dokumentation folgt|fehlt
noch zu .
à documenter|faire|compléter
sans description
por documentar|hacer
sin descripción
"""
DOC_WORDS = "doc docs documentation description descriptions comment comments docstring docstrings".split()
QUESTION_WORDS = "if whether how what that which who why when where".split()
NOTHING_ZH = re.compile(r"(?:(?:待补充|待完善|暂无(?:说明|描述|文档)|见上文?|无)\W*)*(?:参见.*)?")
CLAUSE = re.compile(r"[.!?;:,](?=\s|$)|[…—]")


def _phrases() -> dict[str, list]:
    """Each phrase as places (words or None, optional), by the words that it may begin with."""
    out: dict[str, list] = {}
    for line in NOTHING.strip().splitlines():
        places = []
        for part in line.split():
            words = part.rstrip("?")
            places.append((words if words in (".", "~") else {x for w in words.split("|") for x in (DOC_WORDS if w == "DOC" else [w])}, part.endswith("?")))
        for w in places[0][0]:
            out.setdefault(w, []).append(places[1:])
    return out


PHRASES = _phrases()


def says_nothing(text: str) -> bool:
    """Only phrases of NOTHING, one after the other; walked once from left to right, each clause for itself."""
    if NOTHING_ZH.fullmatch(text):
        return True
    for clause in CLAUSE.split(text.lower()):
        words = [w for x in clause.split() if (w := x.strip(".,;:!?()[]{}<>@\"'`*#-"))]
        ends = {0}
        for i, word in enumerate(words):
            if i not in ends:
                continue
            ends.remove(i)
            for places in PHRASES.get(word, ()):
                at = {i + 1}
                for allowed, optional in places:
                    step = {k + 1 for k in at if k < len(words) and (allowed == "." or (words[k] not in QUESTION_WORDS if allowed == "~" else words[k] in allowed))}
                    at = at | step if optional else step
                ends |= at
        if len(words) not in ends:
            return False
    return True


@dataclass
class Function:
    name: str
    line: int  # of its name, from 1
    start: int  # of its source
    end: int
    doc: str | None


def name_words(name: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+", name)} | {name.lower()}


def _without_blocks(doc: str) -> str:
    """Without the parameter, return and like elements and what they hold; an element that is not closed stays."""
    out, at, opened = [], 0, None
    for m in XML_TAG.finditer(doc):
        closing, name = m.group(1), m.group(2).lower()
        if opened is None and not closing:
            if m.group().endswith("/>"):
                out.append(doc[at : m.start()] + "\n")
                at = m.end()
            else:
                opened = (name, m.start())
        elif opened and closing and name == opened[0]:
            out.append(doc[at : opened[1]] + "\n")
            at, opened = m.end(), None
    return "".join(out) + doc[at:]


def description(doc: str) -> str:
    """Without tag lines and mark-up."""
    lines = [line for line in BREAK.split(_without_blocks(doc)) if not TAG.match(line)]
    return "\n".join(line.strip() for line in MARKUP.sub(" ", "\n".join(lines)).splitlines()).strip()


def is_trivial(doc: str | None, name: str) -> bool:
    text = description(doc or "")
    if not text or says_nothing(" ".join(text.split())):
        return True
    han = re.findall(r"[㐀-鿿]", text)
    if len(han) >= CHARS:
        return False
    own = name_words(name)
    words = [w for w in re.findall(r"[^\W_]+(?:['’][^\W_]+)*", text) if w.lower() not in own and w.lower() not in ARTICLES and not name_words(w) <= own | ARTICLES]
    return len(words) < WORDS


def comment_text(comment: str) -> str:
    """The words of a comment, without its marks."""
    if comment.startswith("/*"):
        body = re.sub(r"^/\*+!?|\*+/$", "", comment)
        return "\n".join(re.sub(r"^[ \t]*\*+ ?", "", line) for line in BREAK.split(body)).strip()
    return "\n".join(re.sub(r"^[ \t]*(?://+!?|#+) ?", "", line) for line in BREAK.split(comment)).strip()


def _line_starts(code: str) -> list[int]:
    return [0] + [m.end() for m in BREAK.finditer(code)]


def python_functions(code: str) -> list[Function]:
    """From the mark of the first decorator, or ``def``, to the end of the last statement."""
    starts, out = None, []

    def place(line: int, column: int) -> int:
        """Columns of the tree count bytes of UTF-8."""
        a = starts[line - 1]
        text = code[a : starts[line] if line < len(starts) else len(code)]
        return a + (column if text.isascii() else len(text.encode("utf-8", "surrogatepass")[:column].decode("utf-8", "surrogatepass")))

    for node in ast.walk(parse_python(code)):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            starts = starts or _line_starts(code)
            first = place(node.lineno, node.col_offset)
            if node.decorator_list:
                d = node.decorator_list[0]
                first = code.rfind("@", 0, place(d.lineno, d.col_offset))
            out.append(Function(node.name, node.lineno, first, place(node.end_lineno, node.end_col_offset), ast.get_docstring(node)))
    return out


def other_functions(code: str, lang: str) -> list[Function]:
    tokens, nodes = parse_other(code, lang)
    if not nodes:
        return []
    starts = _line_starts(code)
    line_of = lambda pos: bisect_right(starts, pos) - 1
    line_text = lambda n: code[starts[n] : starts[n + 1] if n + 1 < len(starts) else len(code)].strip()
    doc_mark, between = re.compile(DOC[lang]), re.compile(BETWEEN[lang])
    ends = {}  # line on which a comment ends that has its lines for itself -> comment
    for a, b in tokens.comments:
        first, last = line_of(a), line_of(b - 1)
        if not code[starts[first] : a].strip() and not code[b : starts[last + 1] if last + 1 < len(starts) else len(code)].strip():
            ends[last] = (a, b, first)
    out = []
    for name, first, end in nodes:
        doc = None
        n = line_of(tokens.start[first]) - 1
        # between the annotations and the name
        for line in range(line_of(tokens.start[name]) - 1, n, -1):
            if line in ends and doc_mark.match(code, ends[line][0]) and ends[line][0] > tokens.start[first]:
                n = line
                break
        while n >= 0:
            text = line_text(n)
            if n in ends:
                a, b, top = ends[n]
                comment = code[a:b]
                if comment[0] == "#" and between.match(comment) or comment[:2] in ("//", "/*") and between.match(comment):
                    n = top - 1
                    continue
                if doc_mark.match(comment):
                    parts = [comment]
                    if not comment.startswith("/*"):
                        k = top - 1
                        while k in ends and not code.startswith("/*", ends[k][0]) and doc_mark.match(code, ends[k][0]):
                            parts.insert(0, code[ends[k][0] : ends[k][1]])
                            k = ends[k][2] - 1
                        parts = [p for p in parts if not between.match(p)]
                    doc = "\n".join(comment_text(p) for p in parts)
                break
            if not text or not between.match(text):
                break
            n -= 1
        out.append(Function(tokens.text[name], line_of(tokens.start[name]) + 1, tokens.start[first], tokens.end[end - 1], doc))
    return out


def functions(code: str, lang: str) -> list[Function]:
    code = without_mark(code)
    try:
        return python_functions(code) if lang == "python" else other_functions(code, lang)
    except (Invalid, Untold):
        return []


def documented_functions(files: DataFrame) -> DataFrame:
    """file_id, name, line, code, description of every function or method with documentation that is not trivial."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, path, code in zip(batch["file_id"], batch["path"], batch["code"]):
                text, seen, own = without_mark(code), set(), languages(path)
                if len(own) > 1:
                    own = sorted(own, key=ranked(text).index)
                for f in next((found for lang in own if (found := functions(code, lang))), ()):
                    if (f.name, f.line) not in seen and not is_trivial(f.doc, f.name):
                        seen.add((f.name, f.line))
                        rows.append((i, f.name, f.line, text[f.start : f.end], description(f.doc)))
            yield pd.DataFrame(rows, columns=["file_id", "name", "line", "code", "description"])

    rows = files.filter("code is not null and file_id is not null").select("file_id", "path", "code")
    return spread(rows).mapInPandas(run, "file_id long, name string, line int, code string, description string")


def documented_names(files: DataFrame) -> DataFrame:
    """file_id, name, line of the same functions, once."""
    return documented_functions(files).select("file_id", "name", "line").distinct()
