"""Tokens of nine languages: per language a few patterns and word lists."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from sedgemill.llm.peg import Tokens


class LexError(ValueError):
    pass


NUMBER = r"0[xX][\da-fA-F_]+\w*|0[bB][01_]+\w*|0[oO][0-7_]+\w*|\d[\d_]*(?:\.\d[\d_]*|\.(?![\w.]))?(?:[eE][+-]?\d+)?\w*|\.\d[\d_]*(?:[eE][+-]?\d+)?\w*"
DOUBLE = r'"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"'
SINGLE = r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"
CHAR = r"'(?:[^'\\\n\r]|\\(?:u\{?[\da-fA-F]+\}?|x[\da-fA-F]+|[0-7]{1,3}|.))+'"
CHAR1 = r"'(?:[^'\\\n\r]|\\(?:u+[\da-fA-F]{4}|U[\da-fA-F]{8}|x[\da-fA-F]{1,4}|[0-7]{1,3}|.))'"
BLOCK = r"/\*[\s\S]*?\*/"
LINE = r"//[^\n\r]*"
WORD = r"[^\W\d]\w*"


@dataclass
class Lexer:
    words: set[str]  # reserved
    strings: str
    comments: str = f"{BLOCK}|{LINE}"
    chars: str = "(?!)"
    numbers: str = NUMBER
    ident: str = WORD
    ops: str = ""
    extra: str = "(?!)"  # skipped like blanks
    regex_words: set[str] = field(default_factory=set)
    template: str = ""  # mark of strings with nested code
    nested: str = ""  # first characters of tokens that nest to any depth
    nesting: Callable[[str, int], tuple[str, int] | None] = lambda code, i: None  # kind and end of such a token
    semicolons: bool = False  # a line break may end a statement (Go)
    lines: bool = False  # line breaks are tokens (Ruby)

    def __post_init__(self) -> None:
        self.pattern = re.compile(
            rf"(?P<X>{self.extra})|[ \t\f\v\xa0]*(?:(?P<CM>{self.comments})|(?P<NL>\r\n|\n|\r)|(?P<STR>{self.strings})|(?P<CHR>{self.chars})"
            rf"|(?P<NUM>{self.numbers})|(?P<ID>{self.ident})|(?P<OP>{self.ops}))",
            re.M,
        )

    def tokens(self, code: str) -> Tokens:
        t = Tokens([], [], [], [], [], [])
        i, n, broken, depth, match = 0, len(code), False, [], self.pattern.match
        docs: list[tuple[str, bool]] = []
        kind_, text_, start_, end_, broken_ = t.kind, t.text, t.start, t.end, t.broken

        def put(kind: str, a: int, b: int) -> None:
            nonlocal broken
            kind_.append(kind)
            text_.append(code[a:b])
            start_.append(a)
            end_.append(b)
            broken_.append(broken)
            broken = False

        special = "`" * bool(self.template) + "/" * bool(self.regex_words) + self.nested
        while i < n:
            if special:
                k = i
                while k < n and code[k] in " \t":
                    k += 1
                c = code[k : k + 1]
                if c and c in special:
                    if c in self.nested and (found := self.nesting(code, k)):
                        what, j = found
                        if what == "CM":
                            t.comments.append((k, j))
                            broken = broken or "\n" in code[k:j]
                        else:
                            put(what, k, j)
                        i = j
                        continue
                    if c in self.nested and not (c == "/" and self.regex_words):
                        c = ""
                if c and c in special:
                    i = k
                    if c == "`":
                        j = self._template(code, i)
                        put("TPL", i, j)
                        i = j
                        continue
                    if code[i + 1 : i + 2] not in ("/", "*", "") and self._regex_may_start(kind_, broken, code, i) and (m := REGEX.match(code, i)):
                        put("STR", i, m.end())
                        i = m.end()
                        continue
            m = match(code, i)
            if m is None:
                if not code[i:].strip(" \t\f\v\xa0"):
                    break
                raise LexError(f"{i}: {code[i : i + 20]!r}")
            what, j = m.lastgroup, m.end()
            i = m.start(what)
            if what == "NL":
                if self.semicolons and kind_ and (kind_[-1] in GO_ENDS) and not broken:
                    put(";", i, i)
                elif self.lines and kind_ and kind_[-1] not in RUBY_OPEN and (not depth or depth[-1] == "{"):
                    if not RUBY_CONTINUES.match(code, j):
                        put("NL", i, j)
                broken = True
                if docs:
                    j = self._heredocs(code, j, docs)
            elif what == "CM":
                t.comments.append((i, j))
                if "\n" in m.group(what):
                    if self.semicolons and kind_ and kind_[-1] in GO_ENDS and not broken:
                        put(";", i, i)
                    broken = True
            elif what == "X":
                pass
            elif what == "ID":
                w = code[i:j]
                put(w if w in self.words else "ID", i, j)
            elif what == "OP":
                w = code[i:j]
                if self.lines:
                    if w in "([{":
                        depth.append(w)
                    elif w in ")]}" and depth:
                        depth.pop()
                put("LIFE" if w[0] == "'" else w, i, j)
            else:
                if self.lines and what == "STR" and (h := HEREDOC.match(code, i)):
                    docs.append((h.group(2), bool(h.group(1))))
                put(what, i, j)
            i = j
        if docs:
            raise LexError("a here-document is not closed")
        if self.semicolons and kind_ and kind_[-1] in GO_ENDS:
            put(";", n, n)
        broken = True
        put("EOF", n, n)
        return t

    def _template(self, code: str, i: int) -> int:
        i += 1
        while i < len(code):
            c = code[i]
            if c == "\\":
                i += 2
            elif c == "`":
                return i + 1
            elif code.startswith("${", i):
                depth, i = 1, i + 2
                while i < len(code) and depth:
                    c = code[i]
                    if c == "`":
                        i = self._template(code, i) - 1
                    elif c in "\"'":
                        m = re.compile(DOUBLE if c == '"' else SINGLE).match(code, i)
                        if not m:
                            raise LexError(f"{i}: string")
                        i = m.end() - 1
                    depth += (c == "{") - (c == "}")
                    i += 1
            else:
                i += 1
        raise LexError("a template is not closed")

    def _regex_may_start(self, kinds: list[str], broken: bool, code: str, i: int) -> bool:
        if not kinds:
            return True
        k = kinds[-1]
        if self.lines and k == "ID":  # a command call with a pattern
            return code[i - 1 : i] == " " and code[i + 1 : i + 2] != " "
        return k not in ("ID", "NUM", "STR", "TPL", "CHR", ")", "]", "}", "this", "super", "self", "true", "false", "null", "nil", "end")

    def _heredocs(self, code: str, j: int, docs: list[tuple[str, bool]]) -> int:
        while docs:
            word, loose = docs.pop(0)
            m = re.compile(rf"^{'[ \t]*' if loose else ''}{re.escape(word)}[ \t]*(?=\r?$)", re.M).search(code, j)
            if not m:
                raise LexError(f"here-document {word} is not closed")
            j = m.end()
        return j


def _rust_comment(code: str, i: int) -> tuple[str, int] | None:
    if not code.startswith("/*", i):
        return None
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(code, i):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return "CM", m.end()
    raise LexError("a comment is not closed")


def _ruby_code(code: str, i: int) -> int:
    """End of an interpolation whose code begins at i, after its closing brace."""
    depth, last, n = 1, "{", len(code)
    while i < n:
        c = code[i]
        if found := _ruby_string(code, i) if c in "\"`%" else None:
            i, last = found[1], '"'
            continue
        if c == "'" and (m := RUBY_SINGLE.match(code, i)) or c == "/" and last in "(,=~{|&!;[\n" and (m := RUBY_REGEX.match(code, i)):
            i, last = m.end(), '"'
            continue
        if c == "?" and (m := RUBY_CHAR.match(code, i)) and not (last.isalnum() or last in "_)]}\"'"):
            i, last = m.end(), '"'
            continue
        if c == "#" and code[i - 1] in " \t\n{":  # a comment
            i = e if (e := code.find("\n", i)) >= 0 else n
            continue
        depth += (c == "{") - (c == "}")
        i += 1
        if not depth:
            return i
        last = last if c in " \t" else c
    raise LexError("an interpolation is not closed")


def _ruby_string(code: str, i: int) -> tuple[str, int] | None:
    """A string of Ruby that interpolates, or one with paired delimiters; code within it nests to any depth."""
    first, n = code[i], len(code)
    opened, closed, interpolates, flags = "", first, True, False
    if first == ":":
        if code[i + 1 : i + 2] != '"':
            return None
        i, closed = i + 1, '"'
    elif first == "%":
        m = RUBY_PERCENT.match(code, i)
        if not m:
            return None
        opened, interpolates, flags, i = m.group(2), m.group(1) not in ("q", "w", "i"), True, m.end() - 1
        closed = {"{": "}", "(": ")", "[": "]"}[opened]
    depth, i = 1, i + 1
    while i < n:
        c = code[i]
        if c == "\\":
            i += 2
        elif interpolates and c == "#" and code.startswith("#{", i):
            i = _ruby_code(code, i + 2)
        else:
            i += 1
            depth += (c == opened) - (c == closed)
            if not depth:
                return "STR", (RUBY_FLAGS.match(code, i).end() if flags else i)
    return None


def _csharp_string(code: str, i: int) -> tuple[str, int] | None:
    """An interpolated string of C#, verbatim or not; strings and braces within its holes nest to any depth."""
    m = CS_OPEN.match(code, i)
    if not m:
        return None
    verbatim, i, n = "@" in m.group(), m.end(), len(code)
    while i < n:
        c = code[i]
        if code.startswith(("{{", "}}"), i) or verbatim and code.startswith('""', i) or c == "\\" and not verbatim:
            i += 2
        elif c == '"':
            return "STR", i + 1
        elif c == "{":
            i = _csharp_hole(code, i + 1)
        elif c == "}" or c in "\r\n" and not verbatim:
            return None
        else:
            i += 1
    return None


def _csharp_hole(code: str, i: int) -> int:
    open_, n, start = ["{"], len(code), i
    while i < n:
        c = code[i]
        if c in '$@"' and (found := _csharp_string(code, i)):
            i = found[1]
        elif c in '@"' and (m := CS_PLAIN.match(code, i)) or c == "'" and (m := CS_CHAR.match(code, i)) or c == "/" and (m := CS_COMMENT.match(code, i)):
            i = m.end()
        elif c in "([{":
            open_.append(c)
            i += 1
        elif c in ")]}":
            if PAIRS[open_.pop()] != c:
                raise LexError("a hole of a string is not balanced")
            i += 1
            if not open_:
                if not code[start : i - 1].strip():
                    raise LexError("an empty hole in a string")
                return i
        elif code.startswith("::", i):
            i += 2
        elif c == ":" and len(open_) == 1:  # the format goes up to the end of the hole
            i = code.find("}", i)
            if i < 0:
                break
        elif c in ';"':
            if c == '"' or len(open_) == 1:
                raise LexError("a hole of a string is not closed")
            i += 1
        else:
            i += 1
    raise LexError("a hole of a string is not closed")


RUBY_SINGLE = re.compile(r"'(?:[^'\\]|\\[\s\S])*'")
RUBY_REGEX = re.compile(r"/(?![\s=])(?:[^/\\\[\n\r]|\\.|\[(?:[^\]\\\n\r]|\\.)*\])+/\w*")
RUBY_CHAR = re.compile(r"\?[\"'`{}#](?!\w)")
RUBY_PERCENT = re.compile(r"%([rqQwWiI]?)([{(\[])")
RUBY_FLAGS = re.compile(r"\w*")
CS_OPEN = re.compile(r'(?:\$@?|@\$)"(?!"")')
CS_PLAIN = re.compile(rf'"""[\s\S]*?"""|@"(?:[^"]|"")*"|{DOUBLE}')
CS_CHAR = re.compile(CHAR1)
CS_COMMENT = re.compile(BLOCK)
PAIRS = {"(": ")", "[": "]", "{": "}"}

REGEX = re.compile(r"/(?:[^/\\\[\n\r]|\\.|\[(?:[^\]\\\n\r]|\\.)*\])+/\w*")
HEREDOC = re.compile(r"<<([~-]?)[\"'`]?(\w+)")
RUBY_CONTINUES = re.compile(r"(?:[ \t]*(?:#[^\n]*)?\r?\n)*[ \t]*(?:\.(?!\.)|&\.)")

# Reserved words and operators of each language.
JS_WORDS = set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false let yield await enum".split())
TS_WORDS = JS_WORDS
JAVA_WORDS = set("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split())
CS_WORDS = set("abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split())
C_WORDS = set("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Atomic _Alignas _Alignof _Generic _Noreturn _Static_assert _Thread_local".split())
CPP_WORDS = (C_WORDS - {"restrict", "_Bool", "_Complex", "_Generic", "_Noreturn", "_Atomic"}) | set("alignas alignof and bitand bitor bool catch char8_t char16_t char32_t class concept const_cast consteval constexpr constinit co_await co_return co_yield decltype delete dynamic_cast explicit export false friend mutable namespace new noexcept not nullptr operator or private protected public reinterpret_cast requires static_assert static_cast template this thread_local throw true try typeid typename using virtual wchar_t xor".split())
GO_WORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
RUST_WORDS = set("as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn abstract become box do final macro override priv typeof unsized virtual yield try".split())
RUBY_WORDS = set("BEGIN END alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield __FILE__ __LINE__ __method__".split())
GO_ENDS = {"ID", "NUM", "STR", "CHR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
RUBY_OPEN = {"NL", ";", ",", "(", "[", "{", "|(", "+", "-", "*", "/", "=", "==", "!=", "&&", "||", "<<", "<", ">", "<=", ">=", ".", "&.", "::", "?", "and", "or", "not", "+=", "-=", "*=", "||=", "&&=", "=>", "=~", "!", "->"}

JS_OPS = r"\.\.\.|=>|===|!==|\*\*=|\*\*|==|!=|<<=|<=|\+\+|--|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?!\d)|[-+*/%&|^]=|<<|[-+*/%&|^!~<>=?:;,.(){}\[\]@#]"
JAVA_OPS = r"\.\.\.|->|::|==|!=|<<=|<=|\+\+|--|&&|\|\||[-+*/%&|^]=|<<|[-+*/%&|^!~<>=?:;,.(){}\[\]@]"
CS_OPS = r"=>|->|::|==|!=|<<=|<=|\+\+|--|&&|\|\||\?\?=|\?\?|\?\.|\.\.|[-+*/%&|^]=|<<|[-+*/%&|^!~<>=?:;,.(){}\[\]]"
C_OPS = r"\.\.\.|->|==|!=|<<=|>>=|<=|>=|\+\+|--|&&|\|\||[-+*/%&|^]=|<<|>>|[-+*/%&|^!~<>=?:;,.(){}\[\]]"
CPP_OPS = r"\.\.\.|->\*|->|::|<=>|==|!=|<<=|<=|\+\+|--|&&|\|\||\.\*|[-+*/%&|^]=|<<|[-+*/%&|^!~<>=?:;,.(){}\[\]]"
GO_OPS = r"\.\.\.|<-|:=|==|!=|<<=|>>=|&\^=|&\^|<=|>=|\+\+|--|&&|\|\||[-+*/%&|^]=|<<|>>|[-+*/%&|^!~<>=:;,.(){}\[\]]"
RUST_OPS = r"\.\.\.|\.\.=|\.\.|->|=>|::|==|!=|<=|&&|\|\||[-+*/%&|^]=|[-+*/%&|^!~<>=?:;,.(){}\[\]@#$]"
RUBY_OPS = r"<=>|===|\.\.\.|\.\.|\*\*=|\*\*|=>|->|==|!=|=~|!~|&\.|::|<<=|>>=|<=|>=|&&=|\|\|=|&&|\|\||[-+*/%&|^]=|<<|>>|[-+*/%&|^!~<>=?:;,.(){}\[\]]"

DIRECTIVE = r"^[ \t]*#[ \t]*(?:include[ \t]*(?:<[^>\n]+>|\"[^\"\n]+\")|(?:define|undef|if|ifdef|ifndef|elif|else|endif|pragma|error|line|warning)\b(?:[^\n\\]|\\[^\n]|\\\r?\n)*|[ \t]*$)"
CS_STRINGS = r'"""[\s\S]*?"""|@"(?:[^"]|"")*"|' + DOUBLE
RUBY_STRINGS = (
    r"<<[~-]?(?:[A-Z]\w*|\"\w+\"|'\w+')|\"(?:[^\"\\#]|\\[\s\S]|#(?!\{)|#\{[^{}]*\})*\"|'(?:[^'\\]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`"
    r"|%[rqQwWiI]?\{(?:[^{}\\]|\\[\s\S]|\{[^{}]*\})*\}\w*|%[rqQwWiI]?\((?:[^()\\]|\\[\s\S]|\([^()]*\))*\)\w*|%[rqQwWiI]?\[(?:[^\[\]\\]|\\[\s\S])*\]\w*|%[rqQwWiI](?P<rubyend>[!|/])(?:(?!(?P=rubyend))[^\\]|\\[\s\S])*(?P=rubyend)\w*"
    r"|:\"(?:[^\"\\]|\\.)*\"|:[^\W\d]\w*[?!]?(?!:)|:(?:\[\]=?|[-+*/%<>]|<=>|==|=~)|\?[a-zA-Z](?!\w)"
)

LEXERS = {
    "javascript": Lexer(JS_WORDS, f"{DOUBLE}|{SINGLE}", ops=JS_OPS, ident=r"[^\W\d][\w$]*|[$][\w$]*|#[^\W\d]\w*", comments=rf"\A#![^\n]*|{BLOCK}|{LINE}", regex_words=JS_WORDS, template="`"),
    "java": Lexer(JAVA_WORDS, rf'"""[ \t]*\r?\n(?:[^\\]|\\[\s\S])*?"""|{DOUBLE}', chars=CHAR1, ops=JAVA_OPS, ident=r"[^\W\d]\w*|\$\w*"),
    "csharp": Lexer(CS_WORDS, CS_STRINGS, nested="$@", nesting=_csharp_string, chars=CHAR1, ops=CS_OPS, ident=r"@?[^\W\d]\w*", extra=r"^[ \t]*#[ \t]*(?:region|endregion|if|else|elif|endif|define|undef|nullable|pragma|warning|error|line)\b[^\n]*"),
    "c": Lexer(C_WORDS, rf"(?:u8|[uUL])?{DOUBLE}", chars=rf"[uUL]?{CHAR}", ops=C_OPS, extra=rf"^[ \t]*#[ \t]*ifdef[ \t]+__cplusplus\b[\s\S]*?^[ \t]*#[ \t]*endif[^\n]*|{DIRECTIVE}"),
    "cpp": Lexer(CPP_WORDS, rf'(?:u8|[uUL])?R"(?P<cppend>[^ ()\\\t\v\f\n]{{0,16}})\([\s\S]*?\)(?P=cppend)"|(?:u8|[uUL])?{DOUBLE}', chars=rf"(?:u8|[uUL])?{CHAR}", numbers=NUMBER.replace(r"\d[\d_]*(?:\.\d", r"\d(?:'?\d)*(?:\.\d"), ops=CPP_OPS, extra=DIRECTIVE),
    "go": Lexer(GO_WORDS, rf"`[^`]*`|{DOUBLE}", chars=CHAR1, ops=GO_OPS, semicolons=True),
    "rust": Lexer(RUST_WORDS, comments=LINE, nested="/", nesting=_rust_comment, strings=rf'[bc]?r(?P<rustend>#*)"[\s\S]*?"(?P=rustend)|[bc]?"(?:[^"\\]|\\[\s\S])*"', chars=r"b?'(?:[^'\\\n]|\\(?:u\{[\da-fA-F_]+\}|x[\da-fA-F]{2}|.))'", numbers=r"0[xob][\da-fA-F_]+\w*|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?\d+)?\w*", ops=rf"'[^\W\d]\w*(?!')|{RUST_OPS}", ident=r"r#[^\W\d]\w*|[^\W\d]\w*"),
    "ruby": Lexer(RUBY_WORDS, RUBY_STRINGS, nested="\"`%:", nesting=_ruby_string, comments=r"#[^\n\r]*|^=begin\b[\s\S]*?^=end\b[^\n]*|^__END__[\s\S]*", ops=RUBY_OPS, ident=r"(?:@@|@|\$)[^\W\d]\w*|\$[\d!~&]|[^\W\d]\w*[?!]?(?==[=~>])|[^\W\d]\w*[?!](?!=)|[^\W\d]\w*", numbers=r"0[xob][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[ri]?", lines=True, regex_words=RUBY_WORDS),
}
