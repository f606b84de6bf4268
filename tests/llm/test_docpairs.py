import time

import pytest

from sedgemill.llm import docpairs as D

CASES = {
    "python": ('@x(\n  1)\ndef f(a):\n    """Adds one packet to the open ledger."""\n    def g():\n        "Inner words that say something."\n', [("f", 3), ("g", 5)]),
    "javascript": ("/** Adds one packet to the open ledger. */\nexport async function f(a) {\n  /** Counts the rows of it. */\n  const g = (x) => x;\n}\n/* Plain comment that is no documentation. */\nfunction h() {}\n/** Far away from its function here. */\n\nfunction k() {}\nclass A {\n  /**\n   * Walks every silo of it.\n   * @param x\n   */\n  static m(x) {}\n}\n", [("f", 2), ("g", 4), ("m", 16)]),
    "java": ("class A {\n  /** Walks every spindle of it. */\n  @Override\n  @X(1)\n  int f() { return 1; }\n  // plain words that are long enough\n  void g() {}\n}\n", [("f", 5)]),
    "go": ("package a\n\n// F walks every spindle of it.\n//go:noinline\nfunc F() {\n}\n\n/* G counts the quiet rows here. */\nfunc (t *T) G() {\n}\n\n// H far away from it\n\nfunc H() {\n}\n", [("F", 5), ("G", 9)]),
    "rust": ("/// Walks every spindle of it.\n#[inline]\npub fn f() {}\n// plain words that are long enough\nfn g() {}\n", [("f", 3)]),
    "c": ("/** Walks every spindle of it. */\nstatic int\nf(int a)\n{\n    return 1;\n}\n", [("f", 3)]),
    "cpp": ("class A {\npublic:\n    /// Walks every spindle of it.\n    virtual int f() const { return 1; }\n};\n", [("f", 4)]),
    "ruby": ("# Walks every spindle of it.\n# @param a\ndef f(a)\n  1\nend\n", [("f", 3)]),
    "csharp": ("class A {\n    /// <summary>\n    /// Walks every spindle of it.\n    /// </summary>\n    /// <param name=\"a\">words of the parameter here</param>\n    [X]\n    public int F(int a) { return 1; }\n}\n", [("F", 7)]),
}


@pytest.mark.parametrize("lang", sorted(CASES))
def test_functions(lang):
    code, want = CASES[lang]
    for text in (code, code.replace("\n", "\r\n"), "\ufeff" + code):
        got = [(f.name, f.line) for f in D.functions(text, lang) if not D.is_trivial(f.doc, f.name)]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("doc", [None, "", "TODO", "todo: document this", "Undocumented.", "Tbd.", "N/A", "No description.", "...", "FIXME: write docs", "See above.", "-", "Merge batch.", "The merge batch of it", "@param x a long text about it\n:returns: many words here too", "<inheritdoc/>", "{@inheritDoc}", "合并行", "Documentation to be written later", "docs coming soon", "TODO add the docs", "See the ledger module for details.", "Missing docstring, see above"])
def test_trivial(doc):
    assert D.is_trivial(doc, "mergeBatch")


@pytest.mark.parametrize("doc", ["Adds rows to it.", "把quarry合并到台账中", "Gibt den Stapel zurueck.", "Merge all the open rows.", "Documentation generator entry point", "Description of the parser", "See whether a row fits it", "See above. Adds rows to the ledger.", "TODO tidy the ledger rows later"])
def test_not_trivial(doc):
    assert not D.is_trivial(doc, "mergeBatch")


def test_source_ranges():
    code = "x = 1\n\ndef f():\n    return 2\n\ny = 2\n"
    f = D.functions(code, "python")[0]
    assert code[f.start : f.end] == "def f():\n    return 2"
    code = "class A:\n    x = 'é'; y = 1\n    @d('é')\n    # between\n    @e\n    def f(self): return 'ü'; z = 1  # trailing\r\n    async def g(): 'Ω'; return 1 # x\n"
    f, g = D.functions(code, "python")
    assert code[f.start : f.end] == "@d('é')\n    # between\n    @e\n    def f(self): return 'ü'; z = 1"
    assert code[g.start : g.end] == "async def g(): 'Ω'; return 1"
    js = "let a = 1;\nfunction f() { return 1; }\nlet b;"
    f = D.functions(js, "javascript")[0]
    assert js[f.start : f.end] == "function f() { return 1; }"


def test_table(spark):
    rows = [(1, "a.py", CASES["python"][0], 0), (1, "a.py", CASES["python"][0], 0), (2, "b.py", "def (", 0), (3, None, "x", 0), (4, "d.py", None, 0)]
    files = spark.createDataFrame(rows, "file_id long, path string, code string, name int")
    assert sorted((r["file_id"], r["name"], r["line"]) for r in D.documented_names(files).collect()) == [(1, "f", 3), (1, "g", 5)]
    assert D.documented_functions(files).filter("file_id = 1 and name = 'f'").first()["description"] == "Adds one packet to the open ledger."


@pytest.mark.parametrize("part", ["see a ", "todo ", "documentation is missing ", "<param> ", "<p ", "add a doc x ", "no docs yet. ", "inherit docs from see ", "{@a ", "@param "])
def test_long_comments_take_linear_time(part):
    began = time.time()
    D.is_trivial(part * 100_000, "mergeBatch")
    assert time.time() - began < 3
