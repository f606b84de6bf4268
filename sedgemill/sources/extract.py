"""Nodes and edges from files that describe structure: DDL, dependency manifests, symbol indexes, tool configurations, Terraform, Python.

All take (path, text) rows and give src, dst, type rows, or names. Texts that cannot be read give no rows; nulls give none; repeated
rows give repeated results, which ``sinks.unique_edges`` folds.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = "path string, src string, dst string, type string"


SQL_TOKEN = re.compile(r"""--[^\n]*|/\*[\s\S]*?\*/|'(?:[^']|'')*'|"(?P<dq>(?:[^"]|"")*)"|`(?P<bq>[^`]*)`|\[(?P<sq>[^\]\n]*)\]|(?P<word>[^\W\d][\w$]*)|(?P<mark>[(),.;])|\d[\w.]*|\S""")
# Words that open a table constraint instead of a column.
CONSTRAINTS = {"constraint", "primary", "foreign", "unique", "check", "exclude", "key", "index", "like", "period"}


def _sql_tokens(text: str) -> list[tuple[str, str]]:
    """kind (word, name, mark or other) and text; names are quoted identifiers without their quotes, comments are left out."""
    out = []
    for m in SQL_TOKEN.finditer(text):
        kind, token = m.lastgroup, m.group()
        if kind in ("dq", "bq", "sq"):
            out.append(("name", m.group(kind)))
        elif kind:
            out.append((kind, token))
        elif not token.startswith(("--", "/*")):
            out.append(("other", token))
    return out


class _Sql:
    """A walk over the tokens of a script, for its table definitions."""

    def __init__(self, text: str) -> None:
        self.tokens, self.i = _sql_tokens(text), 0

    def is_word(self, *words: str) -> bool:
        return self.i < len(self.tokens) and self.tokens[self.i][0] == "word" and self.tokens[self.i][1].lower() in words

    def skip(self, *words: str) -> None:
        while self.is_word(*words):
            self.i += 1

    def name(self) -> str | None:
        """The last part of a dotted name."""
        found = None
        while self.i < len(self.tokens) and self.tokens[self.i][0] in ("word", "name"):
            found, self.i = self.tokens[self.i][1], self.i + 1
            if self.tokens[self.i : self.i + 1] != [("mark", ".")]:
                break
            self.i += 1
        return found

    def parts(self) -> list[list[tuple[str, str]]] | None:
        """What commas part within the brackets that open here; None if they never close."""
        depth, out = 0, [[]]
        while self.i < len(self.tokens):
            token = self.tokens[self.i]
            self.i += 1
            depth += (token == ("mark", "(")) - (token == ("mark", ")"))
            if not depth:
                return [p for p in out if p]
            if depth == 1 and token == ("mark", ","):
                out.append([])
            elif depth > 1 or token != ("mark", "("):
                out[-1].append(token)
        return None

    def tables(self) -> Iterator[tuple[str, list]]:
        while self.i < len(self.tokens):
            if not self.is_word("create"):
                self.i += 1
                continue
            self.i += 1
            self.skip("or", "replace", "global", "local", "temporary", "temp", "unlogged", "external")
            if not self.is_word("table"):
                continue
            self.i += 1
            self.skip("if", "not", "exists")
            name = self.name()
            if name and self.tokens[self.i : self.i + 1] == [("mark", "(")] and (parts := self.parts()) is not None:
                yield name, parts


def _ddl(text: str) -> Iterator[tuple[str, str, str]]:
    """table, what (column or references), name of each column and foreign key."""
    for table, parts in _Sql(text).tables():
        for part in parts:
            (kind, first), rest = part[0], part[1:]
            if rest and (kind == "name" or kind == "word" and first.lower() not in CONSTRAINTS):
                yield table, "column", first
            for k, token in enumerate(part):
                if token[0] == "word" and token[1].lower() == "references":
                    walk = _Sql("")
                    walk.tokens, walk.i = part, k + 1
                    if target := walk.name():
                        yield table, "references", target


def _definitions(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *x) for p, t in zip(b["path"], b["text"]) if isinstance(t, str) for x in _ddl(t)]
            yield pd.DataFrame(rows, columns=["path", "name", "what", "found"])

    return files.select("path", "text").mapInPandas(run, "path string, name string, what string, found string")


def ddl_columns(files: DataFrame) -> DataFrame:
    """path, name, column of every column definition of a CREATE TABLE statement."""
    return _definitions(files).filter("what = 'column'").select("path", "name", F.col("found").alias("column"))


def ddl_references(files: DataFrame) -> DataFrame:
    """path, src, dst, type of every foreign key."""
    return _definitions(files).filter("what = 'references'").select("path", F.col("name").alias("src"), F.col("found").alias("dst"), F.col("what").alias("type"))


def symbol_index(files: DataFrame) -> DataFrame:
    """Edges of a symbol index in JSON: documents, symbols, relationships."""
    schema = "documents array<struct<symbols:array<struct<symbol:string,relationships:array<struct<symbol:string,is_implementation:boolean,is_definition:boolean>>>>>>"
    symbols = files.select("path", F.explode(F.from_json("text", schema)["documents"]).alias("d")).select("path", F.explode("d.symbols").alias("s"))
    rel = symbols.select("path", F.col("s.symbol").alias("symbol"), F.explode("s.relationships").alias("r"))
    # the name in the last descriptor: after the last slash, before brackets and closing dots
    short = lambda c: F.regexp_extract(c, r"([^/(]*?)(?:\([^/]*)?\.*$", 1)
    kind = F.when(F.col("r.is_implementation"), "scip_impl").when(F.col("r.is_definition"), "scip_def").otherwise("scip_ref")
    return rel.select("path", short("symbol").alias("src"), short("r.symbol").alias("dst"), kind.alias("type")).filter("dst <> ''")


def tool_servers(files: DataFrame) -> DataFrame:
    """Edges of a tool-server configuration: command, package, environment of each server."""
    schema = "mcpServers map<string,struct<command:string,args:array<string>,env:map<string,string>>>"
    servers = files.select("path", F.explode(F.from_json("text", schema)["mcpServers"]).alias("src", "c"))
    package = F.element_at(F.filter("c.args", lambda a: (a.startswith("@") | a.contains("/")) & ~a.startswith("-")), 1)
    out = F.flatten(
        F.array(
            F.array(F.struct(F.col("c.command").alias("dst"), F.lit("references").alias("type")), F.struct(package.alias("dst"), F.lit("references").alias("type"))),
            F.transform(F.map_keys(F.coalesce("c.env", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e.alias("dst"), F.lit("requires_env").alias("type"))),
        )
    )
    return servers.select("path", "src", F.explode(out).alias("e")).select("path", "src", "e.dst", "e.type").filter("dst is not null")


def _node_package(text: str) -> Iterator[str]:
    data = json.loads(text)
    for group in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        yield from data.get(group) or ()


def _compiler_settings(text: str) -> Iterator[str]:
    base = json.loads(text).get("extends")
    yield from [base] if isinstance(base, str) else base or ()


def _python_project(text: str) -> Iterator[str]:
    project = tomllib.loads(text).get("project", {})
    for asked in [project.get("dependencies", ()), *project.get("optional-dependencies", {}).values()]:
        for one in asked:
            yield re.match(r"\s*([\w.-]*)", one).group(1)


def _rust_package(text: str) -> Iterator[str]:
    data = tomllib.loads(text)
    for group in ("dependencies", "dev-dependencies", "build-dependencies"):
        yield from data.get(group, ())


def _go_module(text: str) -> Iterator[str]:
    listed = False
    for line in text.splitlines():
        words = line.split("//")[0].split()
        if words[:1] == ["require"]:
            words, listed = words[1:], words[1:] == ["("]
        elif not listed:
            continue
        if words[:1] == [")"]:
            listed = False
        elif len(words) == 2 and words[1].startswith("v"):
            yield words[0].rsplit("/", 1)[-1]


READERS = {"package.json": _node_package, "tsconfig.json": _compiler_settings, "pyproject.toml": _python_project, "cargo.toml": _rust_package, "go.mod": _go_module}


def _dependencies(path: str, text: str) -> list[str]:
    """What the manifest asks for, once each; nothing if it cannot be read or is of no known name."""
    read = READERS.get(path.rsplit("/", 1)[-1].lower())
    try:
        return list(dict.fromkeys(read(text))) if read else []
    except (ValueError, AttributeError, TypeError):
        return []


def dependencies(files: DataFrame) -> DataFrame:
    """path, src, dst, type: what a dependency manifest asks for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, p, str(d), "depends_on") for p, t in zip(b["path"], b["text"]) if isinstance(t, str) for d in _dependencies(p, t) if d]
            yield pd.DataFrame(rows, columns=["path", "src", "dst", "type"])

    return files.select("path", "text").mapInPandas(run, EDGE)


HCL_TOKEN = re.compile(r'#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/|<<[-~]?(?P<doc>\w+)\n[\s\S]*?\n[ \t]*(?P=doc)\b|"(?P<text>(?:[^"\\]|\\.|(?<=\$)\{[^}]*\})*)"|(?P<word>[\w-]+(?:\.[\w-]+)*)|(?P<mark>[{}])|[^\s\w]')
DOTTED = re.compile(r"[\w-]+(?:\.[\w-]+)+")
#: How a block is called by others, by its kind and labels.
BLOCK_NAMES = {"resource": "{0}.{1}", "data": "{0}.{1}", "module": "module.{0}", "variable": "var.{0}", "output": "output.{0}", "provider": "{0}"}


def _hcl_blocks(text: str) -> Iterator[tuple[str, list[str]]]:
    """Name and dotted words of each block at the top, whatever nests in it; comments count for nothing, a block that is not closed for what it holds."""
    depth, head, name, held = 0, [], None, []
    for m in HCL_TOKEN.finditer(text):
        kind, token = m.lastgroup, m.group()
        if not depth and kind in ("word", "text"):
            head.append(m.group(kind))
        elif token == "{" and kind == "mark":
            if not depth:
                form, labels = BLOCK_NAMES.get(head[0] if head else ""), head[1:]
                name = form.format(*labels) if form and len(labels) >= form.count("{") else None
                held = []
            depth += 1
        elif token == "}" and kind == "mark":
            depth -= depth > 0
            if not depth:
                if name:
                    yield name, held
                head, name = [], None
        elif not depth:
            head = []
        elif kind == "word" and "." in token:
            held.append(token)
        elif kind in ("text", "doc"):
            held += DOTTED.findall(token)
    if depth and name:
        yield name, held


def terraform(files: DataFrame) -> DataFrame:
    """path, src, dst, type: references between the blocks of a Terraform file, each once."""

    def refers(word: str, names: set[str]) -> str | None:
        """The block that a dotted word begins with."""
        parts = word.split(".")
        return next((x for n in (2, 1) if (x := ".".join(parts[:n])) in names), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, t in zip(b["path"], b["text"]):
                found = list(_hcl_blocks(t)) if isinstance(t, str) else []
                names = {n for n, _ in found}
                rows += [(p, n, r, "references") for n, held in found for r in dict.fromkeys(refers(w, names) for w in held) if r and r != n]
            yield pd.DataFrame(rows, columns=["path", "src", "dst", "type"])

    return files.select("path", "text").mapInPandas(run, EDGE)


def _python_rows(module: str, code: str) -> list[tuple]:
    try:
        tree = ast.parse(code.removeprefix("﻿"))
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows: list[tuple] = []

    def calls(node: ast.AST) -> list[str]:
        out = []
        for n in ast.walk(node):
            if isinstance(n, ast.Call):
                f = n.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    out.append(name)
        return list(dict.fromkeys(out))

    def brief(node: ast.AST) -> str | None:
        doc = ast.get_docstring(node)
        return doc.strip().split("\n")[0] if doc and doc.strip() else None

    def visit(body: list, owner: str | None) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                sig = f"({ast.unparse(n.args)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else "")
                rows.append((module, "method" if owner else "fn", n.name, owner, n.lineno, sig, brief(n), calls(n)))
            elif isinstance(n, ast.ClassDef):
                rows.append((module, "class", n.name, owner, n.lineno, None, brief(n), [ast.unparse(b) for b in n.bases]))
                visit(n.body, n.name)
            elif isinstance(n, (ast.Import, ast.ImportFrom)) and owner is None:
                names = [n.module or ""] if isinstance(n, ast.ImportFrom) else [a.name for a in n.names]
                rows.append((module, "import", names[0], None, n.lineno, None, None, names))

    visit(tree.body, None)
    top = [n for n in tree.body if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom))]
    if names := calls(ast.Module(top, [])):
        rows.append((module, "main", "__main__", None, 0, None, None, names))
    return rows


def python_symbols(files: DataFrame) -> DataFrame:
    """module, kind (fn, method, class, import, main), name, owner, line, sig, brief, names (calls, bases or imports) of Python sources.

    ``files`` has module and code. Files that do not parse give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["module", "kind", "name", "owner", "line", "sig", "brief", "names"]
        for b in batches:
            rows = [r for m, c in zip(b["module"], b["code"]) if isinstance(c, str) for r in _python_rows(m, c)]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("module", "code").mapInPandas(run, "module string, kind string, name string, owner string, line int, sig string, brief string, names array<string>")
