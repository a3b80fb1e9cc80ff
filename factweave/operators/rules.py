"""Rules: named patterns that turn text into rows, evaluated as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import columns as C

#: Texts that are looked for before a rule is tried; more cost as much as the rule.
MOST_TEXTS = 12


@dataclass(frozen=True)
class Rule:
    """A pattern and which of its groups are which fields. nocase, dotall: its flags."""

    kind: str
    pattern: str
    fields: dict[str, int]
    nocase: bool = False
    dotall: bool = False

    @property
    def java(self) -> str:
        return f"(?U{'iu' * self.nocase}{'s' * self.dotall})" + self.pattern


def needed(pattern: str) -> list[str] | None:
    """Texts, in lower case, of which one at least stands in whatever the pattern matches; null if there are none to name.

    Read from the pattern's parts: of what must all be there, the choice with the longest shortest text.
    """

    def of(parts: list) -> set[str] | None:
        choices, run = [], ""
        for kind, value in [*parts, (None, None)]:
            if str(kind) == "LITERAL":
                run += chr(value)
                continue
            if run:
                choices.append({run.lower()})
            run = ""
            if str(kind) == "SUBPATTERN":
                choices.append(of(value[3]))
            elif str(kind) == "BRANCH":
                branches = [of(branch) for branch in value[1]]
                choices.append(set().union(*branches) if all(branches) else None)
            elif str(kind) in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                choices.append(of(value[2]))
        return max((c for c in choices if c), key=lambda c: (min(map(len, c)), -len(c)), default=None)

    try:
        found = of(list(re._parser.parse(pattern)))
    except re.error:  # what only the session's engine reads
        return None
    found = {x for x in found or () if not any(y != x and y in x for y in found)}
    return sorted(found) if 0 < len(found) <= MOST_TEXTS else None


def _sql(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def might_match(low: str, text: str, rule: Rule) -> str | None:
    """Whether a text, whose lower case is `low`, holds what the rule needs; other letters than ASCII may fold into it, so texts that have
    such are always searched. Null: no way to tell."""
    texts = needed(rule.pattern)
    if texts is None:
        return None
    return " OR ".join([f"octet_length({text}) <> length({text})", *(f"contains({low}, {_sql(x)})" for x in texts)])


def _matches(text: str, rules: list[Rule], fields: list[str], low: str | None, every: bool) -> Column:
    low, found = low or f"lower({text})", []
    for number, rule in enumerate(rules):
        pattern = _sql(rule.java)
        values = [f"nullif(regexp_extract(m, {pattern}, {rule.fields[f]}), '')" if f in rule.fields else "CAST(NULL AS STRING)" for f in fields]
        row = ", ".join([f"'kind', {_sql(rule.kind)}, 'rule_no', {number}, 'match_no', i, 'matched', m", *(f"{_sql(f)}, {v}" for f, v in zip(fields, values, strict=True))])
        matched = f"regexp_extract_all({text}, {pattern}, 0)" if every else f"array_compact(array(regexp_substr({text}, {pattern})))"
        likely = might_match(low, text, rule)
        if likely is not None:
            matched = f"IF({likely}, {matched}, CAST(array() AS ARRAY<STRING>))"
        found.append(f"transform({matched}, (m, i) -> named_struct({row}))")
    return F.expr(f"flatten(array({', '.join(found)}))")


def every_match(text: str, rules: list[Rule], fields: list[str], low: str | None = None) -> Column:
    """array<struct<kind, rule_no, match_no, matched, *fields>>: each match of each rule in a column; groups that took no part, or matched
    empty text, are null.

    A text is searched for a rule only where it holds a text that the rule needs, and once; groups are read from what matched. low: the
    column of the text in lower case, if there is one.
    """
    return _matches(text, rules, fields, low, True)


def first_match(text: str, rules: list[Rule], fields: list[str], low: str | None = None) -> Column:
    """The same with the first match of each rule only; the search ends there."""
    return _matches(text, rules, fields, low, False)


def source_lines(sources: DataFrame) -> DataFrame:
    """source_file, line_no (from 1) and line of every line. sources: source_file, content."""
    rows = sources.select("source_file", F.posexplode(C.lines_of(F.coalesce("content", F.lit("")))).alias("line_no", "line"))
    return rows.withColumn("line_no", F.col("line_no") + 1)


def matches(rows: DataFrame, text: str, rules: list[Rule], fields: list[str], *, every: bool = True) -> DataFrame:
    """A row for each match, with the columns of `rows`. Each row's text is read once for all rules."""
    found = (every_match if every else first_match)(text, rules, fields, "low_")
    return rows.withColumn("low_", F.lower(text)).withColumn("m", F.explode(found)).select(*rows.columns, "m.*")
