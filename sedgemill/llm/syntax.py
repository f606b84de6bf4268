"""Source files that do not parse.

Method: the tokens of every file rank all supported languages; the file is parsed against their grammars in that order until its
status is settled. A language that the path names and that accepts the file settles it (valid); a foreign parse that succeeds while
the own one fails says that the extension is wrong; if all grammars fail, the file is corrupt. Python is compiled by the
interpreter, nine others are parsed by ``grammars``.

An extension that stands for two languages (``.h``: C and C++) is tried in both. Where a row of the manifest declares one of them for
the path, that one counts; else the file is valid if either accepts it.

Defined results: a null code is no file and gives no row; an empty or comment-only file is valid where the language allows an
empty program; a byte order mark at the start and any line ends are fine; unknown extensions (JSX dialects among them) have the status
``unknown`` and are not flagged; brackets may nest to any depth, and what overflows the parser of Python itself, which then tells
nothing, is ``unknown`` too; running out of memory is an error of the task, never one of the file; repeated rows give one row; extra columns are ignored.
"""

from __future__ import annotations

import ast
import contextlib
import functools
import keyword
import math
import re
import sys
import warnings
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgemill.llm.grammars import SOURCES
from sedgemill.llm.lexers import LEXERS, LexError
from sedgemill.llm.peg import Grammar, Tokens
from sedgemill.session import spread

# Extensions; the second language of one that stands for two; what languages are called; tokens that tell languages apart
# beside their reserved words.
EXTENSIONS = {
    "py": "python", "pyi": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript",
    "cts": "typescript", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c++": "cpp", "hpp": "cpp",
    "hh": "cpp", "hxx": "cpp", "h++": "cpp", "ipp": "cpp", "tpp": "cpp", "inl": "cpp", "rb": "ruby", "rake": "ruby", "gemspec": "ruby", "ru": "ruby", "cs": "csharp", "csx": "csharp",
}
ALSO = {"h": "cpp"}
SPELLED = {"c++": "cpp", "cxx": "cpp", "hpp": "cpp", "h": "c", "ansi c": "c"}
MARKS = {
    "python": ": @ # ** -> := * self cls None True False elif print len range str int list dict __init__ __name__",
    "javascript": "{ } : ; ! ? && => === !== ?? ?. ` document console require module exports undefined async of Math Object Array JSON",
    "typescript": "{ } : ; ! ? && => === !== ?? ?. ` as any unknown never readonly interface type string number boolean undefined async of public private Promise Record Map",
    "java": "{ } : ; ! ? && @ -> :: String System Override List Map Integer ArrayList HashMap Object var record",
    "csharp": "{ } : ; ! ? && @ $ => ?? ?. get set var async await Task List Dictionary Console namespace using record yield partial",
    "c": "{ } ; ! ? && * & -> #include #define #ifdef #endif NULL size_t uint8_t int32_t printf malloc free",
    "cpp": "{ } : ; ! ? && * & -> :: << #include #define #endif std vector string map nullptr override final cout size_t",
    "go": "{ } : ! && * & := <- ` nil error string int byte bool make append len fmt err",
    "rust": "{ } : ; ! ? && * & | # ' :: -> => Some None Ok Err Vec String Option Result usize i32 i64 u8 u32 u64 str bool",
    "ruby": "{ } : ! ? && | & @ @@ # => &. << :: puts attr_reader attr_accessor require require_relative each map nil? new lambda proc raise",
}
LANGUAGES = ["python", *SOURCES]
TOKEN = re.compile(r"""/\*[\s\S]*?\*/|//[^\n]*|"{3}[\s\S]*?"{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|\#[ ][^\n]*|\#?[^\W\d]\w*[?!]?|===|!==|:=|=>|->|<-|::|\?\?|\?\.|&\.|&&|\*\*|<<|@@|[^\w\s]""")
TWOFOLD = rf"(?i)\.(?:{'|'.join(ALSO)})\s*$"
NEEDS_CODE = ("go", "java", "c", "cpp", "csharp", "rust")  # an empty file is no program


class Invalid(ValueError):
    """The text is no program of the language."""


class Untold(Exception):
    """The parser gave up: whether the text is a program is not known."""


@functools.cache
def grammar(lang: str) -> Grammar:
    return Grammar(*SOURCES[lang])


@functools.cache
def vocabulary() -> dict[str, tuple[float, ...]]:
    """For each telling token, what it is worth to each language, in the order of LANGUAGES: its log-likelihood, if the words of a language are equally likely."""
    words = {lang: set(MARKS[lang].split()) | (set(keyword.kwlist) if lang == "python" else LEXERS["javascript" if lang == "typescript" else lang].words) for lang in LANGUAGES}
    every = set().union(*words.values())
    worth = lambda lang, w: -math.log(len(words[lang])) if w in words[lang] else -math.log(20 * len(every))
    return {w: tuple(worth(lang, w) for lang in LANGUAGES) for w in every}


@contextlib.contextmanager
def any_depth() -> Iterator[None]:
    """Calls between functions of Python live on the heap, so nesting is bounded by memory alone; the limit of calls is put back afterwards."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(1 << 30)
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def languages(path: str | None) -> list[str]:
    """The languages that the extension of the path stands for."""
    name, dot, extension = (path or "").rsplit("/", 1)[-1].rpartition(".")
    first = EXTENSIONS.get(extension.lower()) if dot else None
    return [x for x in (first, ALSO.get(extension.lower())) if x] if first else []


def language(path: str | None) -> str | None:
    """By the extension of the path, the first that it stands for; None if there is none that is known."""
    return next(iter(languages(path)), None)


def without_mark(code: str) -> str:
    return code[1:] if code.startswith("﻿") else code


def _balanced_directives(code: str) -> bool:
    depth = 0
    for m in re.finditer(r"^[ \t]*#[ \t]*(if|ifdef|ifndef|endif)\b", re.sub(r"/\*[\s\S]*?\*/", " ", code), re.M):
        depth += -1 if m.group(1) == "endif" else 1
        if depth < 0:
            return False
    return depth == 0


def parse_python(code: str, tree: bool = True) -> ast.Module | None:
    """The tree, if it is asked for, of what the compiler takes; nothing is run."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                compile(code, "<file>", "exec", dont_inherit=True)
            except RecursionError:  # a limit of the compiler: the tree alone tells
                ast.parse(code)
            return ast.parse(code) if tree else None
    except (SyntaxError, ValueError) as e:
        raise Invalid(str(e)) from None
    except RecursionError as e:
        raise Untold(str(e)) from None
    except MemoryError as e:
        if "too complex" in str(e):  # the stack of the parser is full, not the memory
            raise Untold(str(e)) from None
        raise


def parse_other(code: str, lang: str) -> tuple[Tokens, list[tuple[int, int, int]]]:
    """Tokens and function nodes (token of the name, first token, end token)."""
    with any_depth():
        try:
            tokens = LEXERS["javascript" if lang == "typescript" else lang].tokens(code)
        except LexError as e:
            raise Invalid(str(e)) from None
        if len(tokens.kind) == 1 and lang in NEEDS_CODE:
            raise Invalid("no program")
        if lang in ("c", "cpp") and not _balanced_directives(code):
            raise Invalid("directives")
        nodes = grammar(lang).parse(tokens)
    if nodes is None:
        raise Invalid("grammar")
    return tokens, nodes


def accepts(code: str, lang: str) -> bool | None:
    """Whether the text is a program of the language; None if the parser cannot tell."""
    try:
        if lang == "python":
            parse_python(code, tree=False)
        else:
            parse_other(code, lang)
        return True
    except Invalid:
        return False
    except Untold:
        return None


def is_valid(code: str, lang: str) -> bool:
    return accepts(code, lang) is True


def ranked(code: str) -> list[str]:
    """All languages, the likeliest first, by the tokens of the text outside of strings and comments."""
    words, score = vocabulary(), [0.0] * len(LANGUAGES)
    for token, n in Counter(TOKEN.findall(code)).items():
        if token in words:
            for k, worth in enumerate(words[token]):
                score[k] += n * worth
    return [LANGUAGES[k] for k in sorted(range(len(score)), key=lambda k: -score[k])]


def verdict(code: str, own: list[str]) -> tuple[list[str], list[str], str | None, bool]:
    """Of the languages ``own`` in the order of the ranking: all, those that accept the text; the first foreign one that does, if none of
    them does; and whether a parser gave up on it."""
    code, told = without_mark(code), {}
    order = ranked(code)
    own = sorted(own, key=order.index)
    for lang in order:
        if lang in own or code.strip():
            told[lang] = accepts(code, lang)
        if own and all(o in told for o in own) and any(told[o] or told[o] is None or (told[lang] and lang not in own) for o in own):
            break  # settled
    foreign = next((lang for lang in order if lang not in own and told.get(lang)), None)
    good = [o for o in own if told[o]]
    return own, good, None if good else foreign, not good and any(told[o] is None for o in own)


def status(code: str, lang: str | None) -> tuple[str, str | None]:
    """valid, wrong_extension, corrupt or unknown; and the language that the text parses as."""
    if lang is None:
        return "unknown", None
    _, good, foreign, untold = verdict(code, [lang])
    return ("valid", lang) if good else ("unknown", None) if untold else ("wrong_extension", foreign) if foreign else ("corrupt", None)


def declared_languages(manifest: DataFrame) -> DataFrame:
    """key (of the path), declared: the language that the latest row of each path declares, one spelling for each."""
    lang = F.lower(F.trim("lang"))
    spelled = F.coalesce(F.create_map(*[F.lit(x) for kv in SPELLED.items() for x in kv])[lang], lang)
    rows = manifest.select(_path_key(F.col("path")).alias("key"), spelled.alias("lang"), "seen_at").filter("key <> '' and lang <> ''")
    return rows.groupBy("key").agg(F.max(F.struct("seen_at", "lang"))["lang"].alias("declared"))


def checked_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """file_id, repo, path, lang, status, parses_as of every file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [languages(p) for p in batch["path"]]
            found = [verdict(c, o) if o else ([], [], None, False) for c, o in zip(batch["code"], own)]
            out = batch[["file_id", "repo", "path"]]
            yield out.assign(own=[f[0] for f in found], good=[f[1] for f in found], foreign=[f[2] for f in found], untold=[f[3] for f in found])

    rows = files.filter("code is not null and file_id is not null").select("file_id", "repo", "path", "code")
    found = spread(rows).mapInPandas(run, "file_id long, repo string, path string, own array<string>, good array<string>, foreign string, untold boolean")
    found = found.dropDuplicates(["file_id"])  # after parsing, so that no text is shuffled
    # only paths of two languages ask the manifest; the others keep keys of their own, which match nothing and spread evenly
    key = F.when(F.size("own") > 1, _path_key(F.col("path"))).otherwise(F.concat(F.lit("\n"), F.col("file_id").cast("string")))
    joined = found.withColumn("key", F.coalesce(key, F.lit("\n"))).join(declared_languages(manifest.filter(F.col("path").rlike(TWOFOLD))), "key", "left")
    lang = F.when(F.array_contains("own", F.col("declared")), F.col("declared")).otherwise(F.coalesce(F.try_element_at("good", F.lit(1)), F.try_element_at("own", F.lit(1))))
    other = F.coalesce(F.try_element_at("good", F.lit(1)), F.col("foreign"))
    valid = F.array_contains("good", F.col("lang"))
    status = F.when(F.size("own") == 0, "unknown").when(valid, "valid").when(F.col("untold"), "unknown").when(other.isNotNull(), "wrong_extension").otherwise("corrupt")
    parsed = F.when(valid, F.col("lang")).when(~F.col("untold"), other)
    return joined.withColumn("lang", lang).select("file_id", "repo", "path", "lang", status.alias("status"), parsed.alias("parses_as"))


def unparsable(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """file_id of every file that has a syntax error in its language."""
    return checked_files(files, manifest).filter(F.col("status").isin("wrong_extension", "corrupt")).select("file_id")


def _path_key(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"^(?:\./|/)+", ""))


def rates(checked: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per repo, language and whether the manifest declares the file: files, broken, wrong_extension and the rate of broken ones."""
    declared = manifest.select(_path_key(F.col("path")).alias("key")).filter("key is not null").distinct().withColumn("declared", F.lit(True))
    joined = checked.filter("status <> 'unknown'").withColumn("key", _path_key(F.col("path"))).join(declared, "key", "left")
    bad = F.sum(F.col("status").isin("wrong_extension", "corrupt").cast("long"))
    return joined.groupBy("repo", "lang").agg(
        F.count("*").alias("files"), bad.alias("broken"), F.sum((F.col("status") == "wrong_extension").cast("long")).alias("wrong_extension"),
        F.count("declared").alias("declared"), F.round(bad / F.count("*"), 6).alias("rate"),
    )
