import json

import pytest
from pyspark.sql import functions as F

from sedgemill.sources import extract, readers, sinks


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def test_jsonl(spark, tmp_path):
    p = tmp_path / "facts.jsonl"
    p.write_text('{"fact": "a", "date": "2025-01-01", "extra": 1}\n\nnot json\n{"fact": "b"}\n')
    assert [r["fact"] for r in readers.jsonl(spark, str(p), "facts").collect() if r["fact"]] == ["a", "b"]
    assert readers.jsonl(spark, str(tmp_path / "none.jsonl"), "facts", missing_ok=True).count() == 0
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.jsonl(spark, str(p), "facts", lenient=False).collect()


def test_zones(spark, tmp_path):
    (tmp_path / "a.txt").write_text('---\nid: a\n---\n# Understanding\n```json\n{"topics": ["x"]}\n```\n# Content\n## [seg 1/2]\none\n## [seg 2/2]\ntwo\n')
    parsed = readers.zones(readers.store(spark, str(tmp_path)))
    r = parsed.first()
    assert r["header"] == "id: a" and json.loads(r["understanding"])["topics"] == ["x"]
    assert [(x["n"], x["total"], x["text"].strip()) for x in readers.segments(parsed).orderBy("n").collect()] == [(1, 2, "one"), (2, 2, "two")]


def test_transcript(spark):
    rows = [
        ("user", "s", "1", json.dumps({"content": "hello"})),
        ("assistant", "s", "2", json.dumps({"content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "t", "input": "x" * 400}]})),
        ("user", "s", "3", json.dumps({"content": [{"type": "tool_result", "content": "y" * 600}]})),
    ]
    text = readers.transcript_lines(spark.createDataFrame(rows, "type string, sessionId string, timestamp string, message string")).first()["text"]
    lines = text.split("\n")
    assert lines[0] == "[USER]: hello" and lines[1] == "[ASSISTANT]: hi" and len(lines[2]) == len("[ASSISTANT]: (tool t) ") + 300 and lines[3].endswith("y" * 500)


def test_extractors(spark):
    ddl = files(spark, ("a.sql", "CREATE TABLE orders (id int, cust int references customer(id), primary key (id));\ncreate table if not exists x (a text);"), ("b.sql", None))
    assert sorted((r["name"], r["column"]) for r in extract.ddl_columns(ddl).collect()) == [("orders", "cust"), ("orders", "id"), ("x", "a")]
    assert [(r["src"], r["dst"]) for r in extract.ddl_references(ddl).collect()] == [("orders", "customer")]
    scip = {"documents": [{"symbols": [{"symbol": "p/Foo.", "relationships": [{"symbol": "q/Bar().", "is_implementation": True}]}]}]}
    assert [(r["src"], r["dst"], r["type"]) for r in extract.symbol_index(files(spark, ("i.json", json.dumps(scip)))).collect()] == [("Foo", "Bar", "scip_impl")]
    mcp = {"mcpServers": {"m": {"command": "npx", "args": ["-y", "@a/b"], "env": {"TOKEN": "1"}}}}
    assert sorted((r["dst"], r["type"]) for r in extract.tool_servers(files(spark, ("m.json", json.dumps(mcp)))).collect()) == [("@a/b", "references"), ("TOKEN", "requires_env"), ("npx", "references")]
    deps = files(spark, ("package.json", '{"dependencies": {"a": "1"}}'), ("x/go.mod", "require github.com/q/w v1.2"), ("Cargo.toml", "[dependencies]\nserde='1'"), ("pyproject.toml", "[project]\ndependencies=['numpy>=1']"), ("package.json", "{broken"))
    assert sorted(r["dst"] for r in extract.dependencies(deps).collect()) == ["a", "numpy", "serde", "w"]
    tf = files(spark, ("m.tf", 'resource "aws_vpc" "a" { cidr = "x" }\nresource "aws_subnet" "b" { vpc = aws_vpc.a.id\n t { } }'))
    assert [(r["src"], r["dst"]) for r in extract.terraform(tf).collect()] == [("aws_subnet.b", "aws_vpc.a")]


def test_python_symbols(spark):
    code = 'import os\nclass A(B):\n  "Doc."\n  def m(self, x: int) -> str:\n    return f(x)\nrun()\n'
    rows = {(r["kind"], r["name"]): r for r in extract.python_symbols(spark.createDataFrame([("m", code), ("bad", "def ("), ("none", None)], "module string, code string")).collect()}
    assert set(rows) == {("import", "os"), ("class", "A"), ("method", "m"), ("main", "__main__")}
    assert rows["method", "m"]["sig"] == "(self, x: int) -> str" and rows["method", "m"]["names"] == ["f"] and rows["class", "A"]["names"] == ["B"] and rows["main", "__main__"]["names"] == ["run"]


def test_sinks(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", "calls", "INFERRED", 2), ("a", "b", "calls", "EXTRACTED", 1)], "src string, dst string, type string, confidence string, ord int")
    assert [r["confidence"] for r in sinks.unique_edges(edges, "ord").collect()] == ["EXTRACTED"]
    key = "0123456789abcdef"
    df = spark.createDataFrame([("secret",)], "t string").withColumn("c", sinks.encrypted(F.col("t"), key))
    r = df.select(sinks.decrypted(F.col("c"), key).alias("a"), sinks.decrypted(F.concat(F.lit("AAAA"), "c"), key).alias("b")).first()
    assert (r["a"], r["b"]) == ("secret", None)
    old = spark.createDataFrame([("d1", 1), ("d2", 2)], "date string, n int")
    new = spark.createDataFrame([("d2", 5), ("d3", 3), ("d3", 4)], "date string, n int")
    assert sorted(map(tuple, sinks.upsert(old, new, "date").collect())) == [("d1", 1), ("d2", 5), ("d3", 4)]
    assert [r["date"] for r in sinks.anti(new, old, "date").collect()] == ["d3"]
    sinks.write_jsonl(old, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 2


def test_definitions_with_nested_brackets(spark):
    ddl = """-- create table not_real (a int);
    CREATE TEMP TABLE "my shop".[Order Lines] (id numeric(10, 2) default (1), note text default ');', /* x, */ `weird name` varchar(3),
      qty int check (qty in (1, 2)) references dbo.stock (id), constraint c foreign key (id, qty) references "Parent Rows" (a, b));
    create table open_ended (a int"""
    rows = files(spark, ("a.sql", ddl), ("e.sql", ""))
    assert sorted((r["name"], r["column"]) for r in extract.ddl_columns(rows).collect()) == [("Order Lines", c) for c in ("id", "note", "qty", "weird name")]
    assert sorted((r["src"], r["dst"]) for r in extract.ddl_references(rows).collect()) == [("Order Lines", "Parent Rows"), ("Order Lines", "stock")]


def test_nested_blocks(spark):
    tf = files(spark, ("m.tf", '# resource "x" "y" {\nmodule "net" { source = "./n" }\nvariable "size" {}\nresource "vm" "a" {\n  net = "${module.net.id}-}" # }\n  dyn { n = var.size }\n  t = <<EOT\n  module.net {\n  EOT\n}\noutput "o" { value = vm.a.id }\n'))
    assert sorted((r["src"], r["dst"]) for r in extract.terraform(tf).collect()) == [("output.o", "vm.a"), ("vm.a", "module.net"), ("vm.a", "var.size")]
    deps = files(spark, ("a/go.mod", "module x\nrequire (\n\tgithub.com/q/w v1.2 // indirect\n\tgo.y/z v0.1\n)\n"), ("tsconfig.json", '{"extends": ["a", "b"]}'), ("Cargo.toml", "[dev-dependencies]\nq='1'"), ("other.json", '{"dependencies": {"no": "1"}}'))
    assert sorted(r["dst"] for r in extract.dependencies(deps).collect()) == ["a", "b", "q", "w", "z"]
