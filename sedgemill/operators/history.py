"""Answers from dated events without a model: tallies, timelines; and the choice of a graph query.

Defined results: events without a fact drop out, without a date they count but give no date; questions without a relevant event
have no answer; repeated events of one date and wording count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgemill.functions import text as T
from sedgemill.operators import ranking as R
from sedgemill.operators.blocked import best, reaching
from sedgemill.session import cut

# Rows that tell what was talked about, not what happened.
TOPIC_ROWS = r"^(asked about|discussed|asked |talked about)"
# Graph query, its cues, and how many symbols it needs; the first that fits is taken.
OPERATIONS = [
    ("signature", "parameter|argument|signature|return", 1),
    ("raises", "raise|exception|throw|error", 1),
    ("impact", "impact|affect|transitive.*call|call.*transitive", 1),
    ("usages", "usage|used|uses|reference|rename", 1),
    ("path", "path", 2),
    ("tdeps", "transitive|depend", 1),
    ("imports", "import", 1),
    ("defines", "define|where", 1),
]


def relevance(events: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, Callable]:
    """Events (id, date, fact) without topic rows; by id with their terms and ``said`` (date and wording); weighted terms of the questions; how counts are weighed in BM25."""
    real = events.filter(F.col("fact").isNotNull() & ~F.lower("fact").rlike(TOPIC_ROWS))
    tokens = T.identifier_tokens(F.col("fact"))
    said = F.struct("date", F.lower(F.trim("fact")).alias("f"))
    docs = cut(R.whole(real.select("id", tokens.alias("terms"), F.size(tokens).alias("dl"), said.alias("said")), "id", "said"), "events")
    wanted = asked.select("item_id", F.explode(T.identifier_tokens(F.col("question"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n"))
    return real, docs, *R.searched(docs, cut(wanted, "wanted"), "item_id")


def tally(events: DataFrame, asked: DataFrame) -> DataFrame:
    """item_id, occurrences: events with at least half the best score, once per date and wording."""
    _, docs, wanted, weigh = relevance(events, asked)
    bars = R.half_bars(docs, wanted, "item_id", "id", weigh).filter("best > 0").withColumn("least", F.greatest("least", F.lit(1e-6)))  # scores have six digits
    said = docs.select(F.explode("said").alias("s"), "terms", "dl").select("s.date", "s.f", "terms", "dl").repartition("date", "f").sortWithinPartitions("date", "f")
    return reaching(said, bars, "item_id", ["date", "f"], weigh).select("item_id", F.col("hits").alias("occurrences"))


def timeline(events: DataFrame, asked: DataFrame, k: int = 8) -> DataFrame:
    """item_id, first_date, last_date, best_date, days of the k most relevant events."""
    real, docs, wanted, weigh = relevance(events, asked)
    scored = R.top(best(docs, wanted, "item_id", ["id"], k, weigh=weigh), "item_id", "score", "id", k).drop("rank").filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "id"))
    hits = scored.join(real.select("id", "date"), "id").withColumn("r", rank).filter(F.col("r") <= k)
    first, last = F.min(F.nullif("date", F.lit(""))), F.max("date")
    spans = hits.groupBy("item_id").agg(first.alias("first_date"), last.alias("last_date"), F.min_by("date", "r").alias("best_date"))
    day = lambda c: F.when(F.length(c) == 10, F.expr(f"try_cast({c} as date)"))  # noqa: E731  (dates of month precision have no day)
    return spans.withColumn("days", F.datediff(day("last_date"), day("first_date")))


def code_operation(q: Column, symbol: Column, mentioned: Column) -> Column:
    """Which graph query a question (in small letters) asks for, given the first symbol that it mentions and how many it does."""
    op = F.when((q.contains("most") & q.contains("import")) | symbol.isNull(), "most_imported")
    for name, cues, least in OPERATIONS:
        op = op.when(q.rlike(cues) & (mentioned >= least), name)
    return op.when(q.contains("call") & q.contains("does"), "callees").when(q.contains("call"), "callers").otherwise("defines")
