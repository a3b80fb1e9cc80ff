"""Extractors that users add: rules as rows of a table, and functions of a text, both to be queried with SQL.

A rule row is a pattern and names for its groups; rules of a family become columns like the built-in ones, so a line is searched
without Python. A function `extract(content, source_file)` that returns dictionaries is for what patterns can't say; it runs as a
table function over partitions of the sources' table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from factweave.functions import columns as C
from factweave.operators.rules import Rule, matches, source_lines

RULES = "family string, kind string, pattern string, fields map<string,int>, nocase boolean, dotall boolean, rank int"
#: Rules are part of a plan, so a family has no more than this; a larger one is an error.
MOST_RULES = 500


def rules_of(registry: DataFrame, family: str) -> list[Rule]:
    """The rules of a family in order of rank, then kind and pattern. registry: see RULES; null flags are false."""
    chosen = registry.where(F.col("family") == family).select("kind", "pattern", "fields", "nocase", "dotall", "rank")
    rows = chosen.orderBy(F.col("rank").asc_nulls_last(), "kind", "pattern").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"family {family} has more than {MOST_RULES} rules")
    return [Rule(r.kind, r.pattern, dict(r.fields or {}), bool(r.nocase), bool(r.dotall)) for r in rows]


def rule_facts(sources: DataFrame, rules: list[Rule], *, whole: bool = False, every: bool = True) -> DataFrame:
    """source_file, kind, line (null for whole texts), snippet and the fields of all rules. sources: source_file, content.

    whole: patterns see texts rather than lines. every: every match rather than the first of each rule. No rules give no rows.
    """
    fields = list(dict.fromkeys(f for rule in rules for f in rule.fields))
    rows = sources.select("source_file", F.lit(None).cast("int").alias("line_no"), F.col("content").alias("line")) if whole else source_lines(sources)
    if not rules:
        return rows.where("false").select("source_file", F.lit(None).cast("string").alias("kind"), F.col("line_no").alias("line"), F.lit(None).cast("string").alias("snippet"))
    found = matches(rows, "line", rules, fields, every=every)
    return found.select("source_file", "kind", F.col("line_no").alias("line"), C.snippet(F.col("matched") if whole else F.col("line")).alias("snippet"), *fields)


def create_view(spark: SparkSession, name: str, sources: str, registry: str, family: str, **options: bool) -> None:
    """A view of what the rules of a family find: CREATE VIEW for sources and rules that are tables or views."""
    rule_facts(spark.table(sources), rules_of(spark.table(registry), family), **options).createOrReplaceTempView(name)


@dataclass(frozen=True)
class Extractor:
    """A function of a text and its file that gives a dictionary for each fact, and the fields these have."""

    extract: Callable[[str, str], Iterable[dict]]
    fields: tuple[str, ...]


def register(spark: SparkSession, extractors: dict[str, Extractor], name: str = "extract_facts") -> None:
    """The table function: SELECT * FROM extract_facts(TABLE(sources) PARTITION BY (source_file), 'extractor').

    The table has source_file and content among its columns. Rows: source_file, warning and the extractor's fields as text. A text on
    which the function fails has one row, with a warning; a null text is empty.
    """

    class ExtractFacts:
        def __init__(self) -> None:
            self.chosen = None

        @staticmethod
        def analyze(rows: AnalyzeArgument, extractor: AnalyzeArgument) -> AnalyzeResult:
            if extractor.value not in extractors:
                raise ValueError(f"no extractor {extractor.value}; there are {sorted(extractors)}")
            if not {"source_file", "content"} <= set(rows.dataType.names):
                raise ValueError("the table needs source_file and content")
            fields = ("source_file", "warning", *extractors[extractor.value].fields)
            return AnalyzeResult(StructType([StructField(f, StringType()) for f in fields]))

        def eval(self, rows: Row, extractor: str) -> Iterable[tuple]:
            chosen = extractors[extractor]
            try:
                facts = list(chosen.extract(rows["content"] or "", rows["source_file"]))
            except Exception as error:  # whatever it is, it is this text's
                yield (rows["source_file"], f"{type(error).__name__}: {error}", *[None] * len(chosen.fields))
                return
            for fact in facts:
                yield (rows["source_file"], None, *(None if fact.get(f) is None else str(fact[f]) for f in chosen.fields))

    spark.udtf.register(name, udtf(ExtractFacts))
