import sys
import time

import pytest
from pyspark.sql import functions as F

from sedgemill.llm import syntax as S

VALID = {
    "javascript": [
        "", "// only a comment", "\ufeffconst a = 1\n", "import { a as b } from 'x'; export default class A extends B { #p = 1; static async *m(x = 2) { yield* x; } get v() { return `a ${b + `c`} d`; } }",
        "const f = async (x, {y, ...z}, [q]) => ({ a, b() { return /[({]\\w+\\/\"/g.test(x); } });\nlabel: for (const x of y) { if (x) continue label; else break }", "a\n++b\nlet x = y ? z => z : w?.v?.[0] ?? 1;",
        "switch (x) { case 1: break; default: { } }\ntry { } catch { } finally { }",
    ],
    "typescript": [
        "const f = <T,>(x: T): T => x; let v = (1 as unknown) as number[];", "export abstract class A<T extends B> implements C { private readonly x: Map<string, number[]> = new Map<string, number[]>(); constructor(private y?: string) { super(); } abstract m(a: number): void }",
        "interface I { a?: string; m(x: number): void; [k: string]: any }\ntype U = 'a' | { b: number } | ((x: string) => void);\nenum E { A = 1, B }", "function isA(x: any): x is string { return typeof x === 'string' && x!.length > 2; }",
    ],
    "java": [
        "package a.b; import java.util.*; public class A extends B implements C { @Override public <T> List<Map<String, Integer>> m(final int[] x, String... y) throws E { Runnable r = () -> emit(1); for (int i = 0; i < 3; i++) { } return new ArrayList<>(); } }",
        'class A { String t = """\n  a " b\n  """; char c = \'}\'; int f() { return switch (x) { case 1 -> 2; default -> { yield 3; } }; } enum K { A, B; } record R(int a) {} }',
    ],
    "go": [
        "package a\n\nimport (\n\t\"fmt\"\n\t. \"x/y\"\n)\n\ntype T struct {\n\trows []int\n}\n\nfunc (t *T) F(a map[string]int, b ...string) (int, error) {\n\tdefer func() { emit(1) }()\n\tfor i := 0; i < 3; i++ {\n\t\tif x, ok := a[\"k\"]; ok {\n\t\t\treturn x, nil\n\t\t}\n\t}\n\tswitch {\n\tcase true:\n\tdefault:\n\t}\n\to := []int{1}\n\t_ = map[string]int{\"a\": 1}\n\treturn 0, fmt.Errorf(`raw { \" (`)\n}\n",
    ],
    "rust": [
        "use std::{a, b::*};\n/* a /* nested */ b */\n#[derive(Debug)]\npub struct A<'a, T: B + 'a> { x: &'a str, y: Vec<Option<T>> }\nimpl<T> A<'_, T> { pub fn f(&self, x: i64) -> i64 { let f = |a: i64| a + 1; match x { 0 => {} 1 | 2 => return 3, _ => {} } if x > 3 { g(x); } let s = r#\"raw { \" (\"#; for i in 0..9 { let _ = i; } println!(\"{} }}\", x); let c = '{'; vec![1, 2]; x } }",
    ],
    "c": ['#include <stdio.h>\nstatic int\nf(const char *s, struct frame *p)\n{\n    do { } while (0);\n    switch (1) { case 1: break; default: break; }\n    char c = \'{\'; int a[] = {1, [2] = 3};\n    return (int) x->y + sizeof(struct frame);\n}\ntypedef struct { int a : 3; } T;\n'],
    "cpp": ['#include <map>\nnamespace a { template <typename T> class B : public C<T> { public: explicit B(int x) : x_(x) {} virtual int f(const std::string &s) const override { auto g = [&](int y) { return y + 1; }; std::vector<std::map<int, int>> v; for (auto &x : std::vector<int>{1, 2}) { h(x); } return R"(raw { " )"[0]; } private: int x_ = 0; }; }'],
    "ruby": [
        "", "require 'set'\nclass A < B\n  attr_reader :a, :b\n  def f(x, y = 1, *z, k: 2, &blk)\n    return 1 if x.nil?\n    [1, 2].each do |v|\n      puts \"a #{v} { (\" unless v == 1\n    end\n    t = <<~TXT\n      def not_real(\n    TXT\n    h = { kind: :a, 'b' => 2 }\n    case x\n    when 1 then 2\n    else 3\n    end\n    r = %r{^\\((\\w+)/}\n    x&.map(&:to_s)\n  rescue E => e\n    nil\n  ensure\n    g\n  end\nend\n", "=begin\nx (\n=end\na = b ? c : d\nputs [1].map { |x| x * 2 }\n",
    ],
    "csharp": ['using System;\nnamespace A.B\n{\n    [Obsolete("x")]\n    public class C : D, I<int>\n    {\n        public int P { get; private set; } = 1;\n        public async Task<int> F(List<int> a, string b = "x") { Func<int, int> f = x => x + 1; foreach (var x in new[] { 1, 2 }) { } var o = new List<int> { 1 }; var s = @"c:\\x {"; string t = $"{15} }}"; return a?.Count ?? 0; }\n    }\n}\n'],
    "python": ["", "# c", "\ufeffx = 1", "def f(*, a: int = 1) -> str:\n    return f'{a!r:>4}'\n", "match x:\n    case [1, *_]: pass\n"],
}


@pytest.mark.parametrize("lang", sorted(VALID))
def test_valid_programs(lang):
    for code in VALID[lang]:
        assert S.status(code, lang) == ("valid", lang), code


@pytest.mark.parametrize("lang", sorted(VALID))
def test_broken_programs(lang):
    code = max(VALID[lang], key=len)
    for broken in (code[: len(code) // 2], code + "\n<<<<<<< HEAD\n", code + "\n[... 12 more bytes not kept]", code.replace("(", "", 1), code + "}"):
        if not S.is_valid(broken, lang):
            continue
        pytest.fail(f"{lang}: {broken[-200:]}")


@pytest.mark.parametrize("code", ["return 1\n", "break\n", "async def f():\n    pass\nawait f()\n", "def f(a, a):\n    pass\n", "def f():\n    x = 1\n    global x\n", "class A:\n    return 1\n", "def f():\n    nonlocal y\n"])
def test_python_that_does_not_compile(code):
    assert S.status(code, "python")[0] != "valid"
    with pytest.raises(S.Invalid):
        S.parse_python(code)


def test_java_modules():
    code = "import a.B;\n@Deprecated open module a.b {\n  requires transitive static c.d;\n  requires transitive;\n  exports a.b to c, d.e;\n  opens a.c;\n  uses a.S;\n  provides a.S with a.T, a.U;\n}\n"
    assert S.status(code, "java") == ("valid", "java") and S.is_valid("module m { }", "java")
    for broken in (code.rstrip()[:-1], code.replace("  uses", "<<<<<<< HEAD\n  uses"), code + "}", code.replace("uses a.S;", "uses ;"), code[: len(code) // 2]):
        assert not S.is_valid(broken, "java"), broken


NESTED = {
    "ruby": ['a = "#{xs.map { |x| x.name }.join}"\n', 'puts "v #{h.fetch(:a) { 0 }} and #{h["k"]} #{"in #{"deep #{ {a: 1}[:a] }"}"}"\n', 'b = "#{s.gsub(/"/) { "}" }}"\nc = %Q{a #{xs.map { |x| { k: { v: x } } }} b}\nd = `ls #{x { 1 }}`\ne = { :"k#{y { 1 }}" => 1 }\n', "f = %w{a {b {c}}}\ng = 7 % x\n"],
    "csharp": ['class A { string F() { return $"{xs.Select(x => new { x.N }).First()} {d:yyyy-MM-dd} {(a ? "b" : $"{c}")} {{ {n,5:0.0}"; } }', 'class A { string S = $@"a ""{h["k"]}"" {\'}\'} {global::B.C}\n{new[] { 1, 2 }}"; string T = @$"{x}"; }'],
    "rust": ["/* " * 9 + "x" + " */" * 9 + "\nfn f() { g(a / b); }\n"],
}


@pytest.mark.parametrize("lang", sorted(NESTED))
def test_nesting_at_any_depth(lang):
    for code in NESTED[lang]:
        assert S.status(code, lang) == ("valid", lang), code
    for broken in {"ruby": ['a = "#{xs.map { |x| x }"\n', 'a = "#{x\n'], "csharp": ['class A { string S = $"{x"; }', 'class A { string S = $"}"; }', 'class A { string S = $"{}"; }'], "rust": ["/* /* */ fn f() {}\n", "fn f() {} */\n"]}[lang]:
        assert not S.is_valid(broken, lang), broken


@pytest.mark.parametrize("lang", ["go", "java", "c", "rust", "csharp"])
def test_wrong_extension(lang):
    code = max(VALID[lang], key=len)
    assert S.status(code, "python") == ("wrong_extension", lang)
    assert S.status(VALID["python"][3], lang) == ("wrong_extension", "python")


def test_corrupt_and_unknown():
    assert S.status("def f(:\n", "python") == ("corrupt", None)
    assert S.status("anything", None) == ("unknown", None)
    assert not S.is_valid("x = " + "(" * 50_000 + ")" * 50_000, "javascript")
    assert S.language("a/b.X.PY") == "python" and S.language("a.b/c") is None and S.language(None) is None


def test_files(spark):
    rows = [(1, "r", "a.py", "x = 1", 0), (2, "r", "b.py", "x = (", 0), (2, "r", "b.py", "x = (", 0), (3, "r", "c.js", None, 0), (4, "q", "d.zz", "?", 0), (5, "q", "e.js", VALID["go"][0], 0)]
    files = spark.createDataFrame(rows, "file_id long, repo string, path string, code string, extra int")
    manifest = spark.createDataFrame([("./A.py", "python"), (None, None)], "path string, lang string").withColumn("seen_at", F.lit(None).cast("timestamp"))
    assert sorted(r["file_id"] for r in S.unparsable(files, manifest).collect()) == [2, 5]
    got = {(r["repo"], r["lang"]): (r["files"], r["broken"], r["wrong_extension"], r["declared"], r["rate"]) for r in S.rates(S.checked_files(files, manifest), manifest).collect()}
    assert got == {("r", "python"): (2, 1, 0, 1, 0.5), ("q", "javascript"): (1, 1, 1, 0, 1.0)}
    assert S.unparsable(files.limit(0), manifest).count() == 0


DEEP = {"javascript": ("x = ", ""), "typescript": ("x = ", ""), "java": ("class A { int f() { return ", "; } }"), "c": ("int f() { return ", "; }"), "cpp": ("int x = ", ";"), "go": ("package a\nvar x = ", "\n"), "rust": ("fn f() { g(", "); }"), "ruby": ("x = ", ""), "csharp": ("class A { int f() { return ", "; } }")}


@pytest.mark.parametrize("lang", sorted(DEEP))
def test_deep_brackets_are_no_error(lang):
    a, b = DEEP[lang]
    limit = sys.getrecursionlimit()
    assert S.status(a + "(" * 5_000 + "1" + ")" * 5_000 + b, lang) == ("valid", lang)
    assert S.status(a + "(" * 5_000 + "1" + ")" * 4_999 + b, lang)[0] == "corrupt"
    assert sys.getrecursionlimit() == limit


def test_what_overflows_the_parser_of_python_is_not_flagged():
    assert S.status("x = " + "not " * 100_000 + "1\n", "python")[0] in ("valid", "unknown")
    assert S.status("x = " + "1 + " * 50_000 + "1\n", "python")[0] in ("valid", "unknown")
    assert S.status("x = " + "1 + " * 50_000 + "\n", "python")[0] != "valid"


@pytest.mark.parametrize("lang", sorted(VALID))
def test_ranking(lang):
    code = max(VALID[lang], key=len)
    assert lang in S.ranked(code)[:3]


def test_headers_of_two_languages(spark):
    c, cpp, both = VALID["c"][0], VALID["cpp"][0], "int f(int a);\n"
    only_c = "int class = 1;\nint f(void) { int new = class; return new; }\n"
    rows = [(1, "r", "a/c.h", only_c), (2, "r", "a/cpp.h", cpp), (3, "r", "a/both.h", both), (4, "r", "told/c.h", cpp), (5, "r", "told/cpp.H", cpp), (6, "r", "told/x.h", only_c), (7, "r", "bad.h", "int f( {"), (8, "r", "go.h", VALID["go"][0]), (9, "r", "x.hxx", cpp), (10, "r", "y.tsx", "?")]
    files = spark.createDataFrame(rows, "file_id long, repo string, path string, code string")
    told = [("told/c.h", "C", 1), ("told/cpp.H", "c", 1), ("./told/CPP.h", "C++", 2), ("told/x.h", "Cpp", 1), ("a/cpp.h", None, 1), ("a/c.h", "python", 1)]
    manifest = spark.createDataFrame(told, "path string, lang string, n int").withColumn("seen_at", F.timestamp_seconds("n"))
    got = {r["file_id"]: (r["lang"], r["status"], r["parses_as"]) for r in S.checked_files(files, manifest).collect()}
    assert got[1] == ("c", "valid", "c") and got[2] == ("cpp", "valid", "cpp") and got[3][1] == "valid"
    assert got[4] == ("c", "wrong_extension", "cpp") and got[5] == ("cpp", "valid", "cpp") and got[6] == ("cpp", "wrong_extension", "c")
    assert got[7][1:] == ("corrupt", None) and got[8][1:] == ("wrong_extension", "go") and got[9] == ("cpp", "valid", "cpp") and got[10] == (None, "unknown", None)


@pytest.mark.parametrize("lang, a, b", [("c", "f(", ")"), ("cpp", "f(", ")"), ("cpp", "(A<B>(", "))"), ("java", "(int) ", ""), ("ruby", "(", ")"), ("rust", "A<A<", ">>"), ("javascript", "(a) => ", ""), ("csharp", "(int) ", ""), ("typescript", "[", "]")])
def test_nested_forms_take_linear_time(lang, a, b):
    before, after = DEEP[lang]
    began = time.time()
    for tail in ("1", ""):
        S.accepts(before + a * 500 + tail + b * 500 + after, lang)
    assert time.time() - began < 5
