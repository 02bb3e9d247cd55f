"""Insecure-code rules over lines: guarded literal patterns, one array per line, exploded.

Every rule is a literal rlike, compiled once a task; a substring test of the literals that any match needs stands
before it. Nothing is joined: a rule's attributes ride in the struct that its match yields.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.catalog import CODE_RULES, SECRET_RULES
from sparkwarden.functions.text import entropy, strip


def holds(line: Column, lower: Column, literals, pattern: str) -> Column:
    """Whether one of the literals that a match of the pattern needs is there."""
    where, folded = (lower, True) if pattern.startswith("(?i)") else (line, False)
    return reduce(lambda a, b: a | b, [where.contains(x.lower() if folded else x) for x in literals])


def matches(line: Column, lower: Column, literals, pattern: str) -> Column:
    """Whether the pattern is found, after a cheap test for one of its literals. Unicode classes as in Python's re."""
    return holds(line, lower, literals, pattern) & line.rlike(f"(?dU){pattern}")


def _candidates(lines: DataFrame, rules: list[tuple]) -> DataFrame:
    """lines, with lower, that hold a literal of some rule: most lines go before any pattern or white space is looked at."""
    some = {(pattern.startswith("(?i)"), x.lower() if pattern.startswith("(?i)") else x) for *_, literals, pattern in rules for x in literals}
    # a literal that holds another of the same case is implied by it
    least = sorted((f, x) for f, x in some if not any(f == g and x != y and y in x for g, y in some))
    tests = [(F.col("lower") if folded else F.col("line")).contains(x) for folded, x in least]
    return lines.withColumn("lower", F.lower("line")).where(reduce(lambda a, b: a | b, tests))


def commented(line: Column) -> Column:
    """Comment lines, and lines with a docstring's quotes."""
    return line.rlike(r"(?U)\A\s*(?:#|//|/\*)") | line.contains('"""') | line.contains("'''")


def suppressed(rule_id: str, line: Column, lower: Column) -> Column | None:
    """What keeps a rule silent on a line of its own: its identifier as text, and two rules' look-alikes."""
    own = line.contains("SAF-") & line.contains(rule_id)
    if rule_id == "SAF-ASSERT":
        return own | lower.contains("def test_") | lower.contains("class test")
    if rule_id == "SAF-COMPILE":
        return own | line.contains("re.compile")
    return own


_SHOWN = r"([A-Za-z0-9+/=_\-]{16,})"


def _found(k: int, hit: Column, rule_id: str, severity: str, confidence: float) -> Column:
    return F.when(hit, F.struct(F.lit(k).alias("rule_ord"), F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence")))


def _code_hits(families: tuple[str, ...], more: Column | None = None) -> list[Column]:
    line, lower = F.col("line"), F.col("lower")
    hits = []
    for k, (rule_id, family, severity, confidence, literals, pattern) in enumerate(CODE_RULES):
        if not families or family in families:
            hit = matches(line, lower, literals, pattern) & ~suppressed(rule_id, line, lower)
            hits.append(_found(k, hit if more is None else more & hit, rule_id, severity, confidence))
    return hits


def _secret_hits() -> list[Column]:
    return [_found(k, matches(F.col("line"), F.col("lower"), literals, pattern), rule_id, severity, confidence) for k, (rule_id, severity, confidence, literals, pattern) in enumerate(SECRET_RULES)]


def _code_line() -> Column:
    return ~commented(F.col("line")) & ~(F.col("lower").contains("import ") & F.col("lower").contains("from "))


def _rows(lines: DataFrame, keep: tuple[str, ...], hits: list[Column], snippet: Column) -> DataFrame:
    rows = lines.select(*keep, "line_no", "line", F.explode(F.array_compact(F.array(*hits))).alias("r"))
    return rows.select(*keep, "line_no", "r.rule_id", "r.severity", "r.confidence", snippet.alias("snippet"), "r.rule_ord")


def code_findings(lines: DataFrame, key: str = "file_path", families: tuple[str, ...] = ()) -> DataFrame:
    """(key, line_no, rule_id, severity, confidence, snippet, rule_ord) for each line and rule that matches it, once.

    families: only rules of these. Comment lines and lines that import from elsewhere have no findings; null lines neither.
    """
    rules = [r for r in CODE_RULES if not families or r[1] in families]
    return _rows(_candidates(lines, rules).where(_code_line()), (key,), _code_hits(families), F.substring(strip(F.col("line")), 1, 80))


def secret_findings(lines: DataFrame, key: str = "file_path", *carried: str) -> DataFrame:
    """(key, carried columns, line_no, rule_id, severity, confidence, snippet, rule_ord) of the secret patterns; the snippet is redacted after four characters."""
    shown = F.concat(F.substring(F.regexp_extract("line", _SHOWN, 1), 1, 4), F.lit("..."))
    return _rows(_candidates(lines, SECRET_RULES), (key, *carried), _secret_hits(), shown)


#: Bits per character from which a quoted value of a suspicious name counts (LOW; MEDIUM from the second on).
ENTROPY_LOW, ENTROPY_MEDIUM = 3.5, 4.2
#: A match needs one of these, in any case.
_SUSPICIOUS = ("key", "secret", "token", "passw", "auth", "cred")
_ASSIGNED = r"(?i)([A-Za-z_]*(?:key|secret|token|passw|auth|cred)[A-Za-z_]*)[\"']?\s*[:=]\s*[\"']([A-Za-z0-9+/=_\-]{20,})[\"']"


def entropy_findings(lines: DataFrame, key: str = "file_path") -> DataFrame:
    """(key, line_no, name, bits, severity): values given to suspicious names that look random."""
    lower = F.lower("line")
    held = lines.where(F.col("line").rlike("[:=]") & reduce(lambda a, b: a | b, [lower.contains(x) for x in _SUSPICIOUS])).where(F.col("line").rlike(_ASSIGNED))
    rows = held.select(key, "line_no", F.regexp_extract("line", _ASSIGNED, 1).alias("name"), F.round(entropy(F.regexp_extract("line", _ASSIGNED, 2)), 6).alias("bits"))
    return rows.where(F.col("bits") >= ENTROPY_LOW).withColumn("severity", F.when(F.col("bits") >= ENTROPY_MEDIUM, "MEDIUM").otherwise("LOW"))
