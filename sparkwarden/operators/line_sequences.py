"""Rules over several lines: a pattern, then others within so many lines, unless something stands between.

A rule is written as  `/open\\(/ then within 5 /write\\(/ unless /close\\(/`  with any number of further steps; `\\/` is a slash
in a pattern. Rules become a plan: one pass tells which patterns a line has, and only those lines are stored; each step is
then a frame over the next lines of the same text. A step is met by the nearest line from which the rest of the rule can
go on, if no line before it has the step's `unless`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.sources.scratch import stored

_STEP = re.compile(r"\s*then\s+within\s+(\d+)\s+/((?:[^/\\]|\\.)+)/(?:\s+unless\s+/((?:[^/\\]|\\.)+)/)?\s*")
_FIRST = re.compile(r"\s*/((?:[^/\\]|\\.)+)/\s*")
_CLASS = re.compile(r"\[([^\\^\[\]&|-])\]")
_PLAIN = re.compile(rf"(?:[^\\^$.|?*+()\[\]{{}}]|{_CLASS.pattern})+(?:\|(?:[^\\^$.|?*+()\[\]{{}}]|{_CLASS.pattern})+)*")


@dataclass(frozen=True)
class Step:
    pattern: str
    within: int = 0
    unless: str | None = None


def parse(text: str) -> list[Step]:
    """The steps of a rule; ValueError tells where one cannot be read."""
    slash = lambda p: p.replace("\\/", "/")
    head = _FIRST.match(text)
    if not head:
        raise ValueError(f"a rule begins with /pattern/: {text!r}")
    steps, at = [Step(slash(head[1]))], head.end()
    while at < len(text):
        m = _STEP.match(text, at)
        if not m:
            raise ValueError(f"expected `then within N /pattern/` at {text[at:]!r}")
        steps.append(Step(slash(m[2]), int(m[1]), slash(m[3]) if m[3] else None))
        at = m.end()
    if len(steps) < 2:
        raise ValueError(f"a rule has two steps at least: {text!r}")
    return steps


def _met(pattern: str) -> Column:
    """Whether a line has the pattern; one that is only literals, or one of several, is looked for as such."""
    if _PLAIN.fullmatch(pattern):
        return reduce(Column.__or__, [F.contains(F.col("line"), F.lit(_CLASS.sub(r"\1", x))) for x in pattern.split("|")])
    return F.col("line").rlike(f"(?dU){pattern}")


def sequence_findings(lines: DataFrame, rules: dict[str, str], *key: str) -> DataFrame:
    """(key, rule_id, line_no, end_line) for each line that a rule begins on and is then carried through; end_line is that of its last step.

    lines: (key, line_no, line), keys telling texts apart; a line number that repeats within a key counts as one line with
    what either has. Null lines have nothing, null keys are a key. Patterns have Unicode's classes. Lines with no pattern of a
    rule go before anything moves; a text's remaining lines are one task's for each rule. Without lines there are no rows.
    """
    parsed = {rule: parse(text) for rule, text in rules.items()}
    patterns = list(dict.fromkeys(p for steps in parsed.values() for s in steps for p in (s.pattern, s.unless) if p))
    tried = lines.select(*key, "line_no", *[F.coalesce(_met(p), F.lit(False)).alias(f"_p{k}") for k, p in enumerate(patterns)])  # each once a line
    has = lambda p: F.col(f"_p{patterns.index(p)}")
    marks = []
    for rule, steps in parsed.items():
        met = F.array(*[has(s.pattern) for s in steps])
        stops = F.array(*[has(s.unless) if s.unless else F.lit(False) for s in steps])
        marks.append(F.struct(F.lit(rule).alias("rule_id"), met.alias("met"), stops.alias("stops")))
    some = F.filter(F.array(*marks), lambda m: F.exists(m["met"], lambda x: x) | F.exists(m["stops"], lambda x: x))
    found = tried.select(*key, "line_no", F.explode(some).alias("m")).select(*key, "line_no", "m.*")
    most = max(len(s) for s in parsed.values())
    either = [F.bool_or(F.coalesce(F.get(c, F.lit(k)), F.lit(False))).alias(f"_{c}{k}") for k in range(most) for c in ("met", "stops")]
    found = found.groupBy(*key, "rule_id", "line_no").agg(*either)
    found = stored(found.sortWithinPartitions("rule_id"), "line-marks")  # each rule reads its own rows: a plan for each would try all patterns again
    parts = []
    for rule, steps in parsed.items():
        rows = found.where(F.col("rule_id") == rule).withColumn("_end", F.when(F.col(f"_met{len(steps) - 1}"), F.col("line_no")))
        for k in range(len(steps) - 1, 0, -1):
            ahead = Window.partitionBy(*key).orderBy("line_no").rangeBetween(1, steps[k].within)
            after = F.min(F.when(F.col("_end").isNotNull(), F.struct("line_no", "_end"))).over(ahead)
            stop = F.min(F.when(F.col(f"_stops{k}"), F.col("line_no"))).over(ahead)
            rows = rows.withColumn("_after", after).withColumn("_stop", stop)
            goes_on = F.col(f"_met{k - 1}") & F.col("_after").isNotNull() & (F.col("_stop").isNull() | (F.col("_stop") >= F.col("_after.line_no")))
            rows = rows.withColumn("_end", F.when(goes_on, F.col("_after._end")))
        parts.append(rows.where("_end is not null").select(*key, "rule_id", "line_no", F.col("_end").alias("end_line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
