"""Readers: JSON-lines tables, folders of documents, session transcripts, live databases.

Defined results: blank lines are skipped; a missing table is empty where ``missing_ok``; a broken line is dropped (``lenient``) or
raises when the rows are read; unknown keys are ignored; a document without the marks of a zone has null there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgemill.sources.schemas import TABLES


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def jsonl(spark: SparkSession, path: str, name: str, lenient: bool = True, missing_ok: bool = False) -> DataFrame:
    """One of the store's tables (``schemas.TABLES``) from a JSON-lines file or folder."""
    schema = TABLES[name]
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if lenient else "FAILFAST").json(path)


def store(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, text of every document of a store, whole."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def zones(documents: DataFrame) -> DataFrame:
    """path, header, understanding (JSON text), segments of documents with three zones."""
    header = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---", 1)
    understanding = F.regexp_extract("text", r"(?s)# Understanding\s*```json\s*(.*?)```", 1)
    parts = F.regexp_extract_all("text", F.lit(r"(?s)## \[seg \d+/\d+\]\n(.*?)(?=\n## \[seg |\n*\z)"), 1)
    none = lambda c: F.nullif(c, F.lit(""))
    return documents.select("path", none(header).alias("header"), none(understanding).alias("understanding"), parts.alias("segments"))


def segments(parsed: DataFrame) -> DataFrame:
    """path, n, total, text of every segment, in order."""
    return parsed.select("path", F.size("segments").alias("total"), F.posexplode("segments").alias("n", "text")).select("path", (F.col("n") + 1).alias("n"), "total", "text")


def transcript_lines(rows: DataFrame, key: str = "sessionId", order: str = "timestamp") -> DataFrame:
    """Per session one text: ``[ROLE]: text`` lines in order; tool calls are cut to 300 characters, results to 500.

    ``message`` is JSON whose ``content`` is a text or an array of blocks (text, tool_use, tool_result).
    """
    block = "array<struct<type:string,text:string,name:string,input:string,content:string>>"
    content = F.get_json_object("message", "$.content")
    blocks = F.coalesce(F.from_json(content, block), F.array(F.struct(*[F.lit(v).cast("string").alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in (("type", "text"), ("text", None), ("name", None), ("input", None), ("content", None))])))
    single = F.size(blocks) == 1
    lines = rows.select(key, order, F.upper("type").alias("role"), content.alias("raw"), F.posexplode(blocks).alias("n", "b"), single.alias("single"))
    text = (
        F.when(F.col("b.type") == "tool_use", F.concat(F.lit("(tool "), "b.name", F.lit(") "), F.substring(F.coalesce("b.input", F.lit("")), 1, 300)))
        .when(F.col("b.type") == "tool_result", F.concat(F.lit("(result) "), F.substring(F.coalesce("b.content", F.lit("")), 1, 500)))
        .otherwise(F.coalesce("b.text", F.when(F.col("single"), F.col("raw"))))
    )
    shown = lines.select(key, order, "n", F.concat(F.lit("["), "role", F.lit("]: "), text).alias("line")).filter("line is not null")
    ordered = F.array_sort(F.collect_list(F.struct(order, "n", "line")))
    return shown.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def database_references(spark: SparkSession, url: str, properties: dict[str, str] | None = None) -> DataFrame:
    """src, dst of the foreign keys of a live database, over JDBC."""
    query = (
        "(select tc.table_name src, ccu.table_name dst from information_schema.table_constraints tc join information_schema.constraint_column_usage ccu "
        "on tc.constraint_name = ccu.constraint_name where tc.constraint_type = 'FOREIGN KEY') k"
    )
    return spark.read.jdbc(url, query, properties=properties or {})
