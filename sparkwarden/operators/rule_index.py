"""Thousands of line rules at once: an index of the three-byte grams that rules cannot do without.

A match of a rule needs one of its literals, and a literal needs each of its grams; the gram that is rarest in the lines
stands for it. A task looks up the grams of all its lines at once, tries the literal around each gram that the index has,
and hands on only lines that hold a literal, with the literals' numbers. Those candidates are joined with the index: first
comes what else a rule needs, then the pattern, rule by rule, so that a pattern is compiled once for many lines. What a rule
costs is the lines that hold it, not a test on every line; lines are cut and read once, and nothing is shuffled.

A rule is a tuple (rule_id, severity, confidence, literals, pattern); a pattern that begins with (?i) ignores case, and
classes have Unicode's meaning.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwarden.operators.code_rules import holds

GRAM = 3
#: Rows of the index that are broadcast (each some hundred bytes); if there are more, Spark chooses how to join.
BLOCK_ROWS = 50_000
#: Bytes of lines that a task looks at at a time. Grams are counted in the first of them, to tell which are rare: that decides how
#: fast lines pass, not what is found.
WORK_BYTES = 4_000_000

_RULE = "entry int, rule_ord int, rule_id string, severity string, confidence double, pattern string, literal string, earlier array<string>, folded boolean"
_CODES = 1 << 21  # of three ASCII characters


def _literals(rules: list[tuple]):
    """(rule_ord, rule, place of the literal, literal in lower case)."""
    for k, rule in enumerate(rules):
        for j, literal in enumerate(rule[3]):
            yield k, rule, j, literal


def _grams(literal: str) -> list[bytes]:
    """The grams of a literal that are whole in any text that has it: of ASCII characters, in lower case."""
    data = literal.lower().encode()
    found = (data[k : k + GRAM] for k in range(len(data) - GRAM + 1))
    return list(dict.fromkeys(g for g in found if max(g) < 128))


def _small(table: DataFrame, rows: int) -> DataFrame:
    """table, marked for broadcast if it has no more than BLOCK_ROWS rows."""
    return F.broadcast(table) if rows <= BLOCK_ROWS else table


def entries(rules: list[tuple]) -> tuple[list[tuple], list[tuple[str, bytes | None]], list[int]]:
    """Rows of the index, one for each literal; of each the literal and, if it is all ASCII, its bytes in lower case; and the rules that
    the index cannot hold: those without literals, or with one of other characters that has no gram."""
    out, sought, rest = [], [], []
    for k, (rule_id, severity, confidence, literals, pattern) in enumerate(rules):
        if not literals or not all(x and (x.isascii() or _grams(x)) for x in literals):
            rest.append(k)
            continue
        folded = pattern.startswith("(?i)")
        said = [x.lower() if folded else x for x in literals]
        for j, x in enumerate(literals):
            out.append((len(out), k, rule_id, severity, float(confidence), f"(?dU){pattern}", said[j], said[:j], folded))
            sought.append((x, x.lower().encode() if x.isascii() else None))  # what is not ASCII may have other bytes in a line's lower case
    return out, sought, rest


def _code(gram: bytes) -> int:
    return gram[0] << 14 | gram[1] << 7 | gram[2]


def _by_gram(sought: list[tuple[str, bytes | None]], count) -> tuple[dict[int, list], np.ndarray, list]:
    """For each gram of the index its (entry, bytes of the literal, where in them the gram is); which grams these are; what is too short for one."""
    held: dict[int, list] = {}
    short = []
    for entry, (literal, data) in enumerate(sought):
        gram = min(_grams(literal), key=lambda g: (count(g), g), default=None)
        if gram is None:
            short.append((entry, data))
        else:
            held.setdefault(_code(gram), []).append((entry, gram if data is None else data, 0 if data is None else data.index(gram)))
    known = np.zeros(_CODES, dtype=bool)
    known[list(held)] = True
    return held, known, short


def _in_lower_case(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts with A-Z in lower case, and where each text begins in them, and the end of the last."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return np.where((raw >= 65) & (raw <= 90), raw | np.uint8(32), raw), at - at[0]


def _standing(raw: np.ndarray, offsets: np.ndarray, begin: np.ndarray, data: bytes) -> np.ndarray:
    """The rows, ascending and once each, in which data stands at one of the places (ascending)."""
    begin = begin[(begin >= 0) & (begin + len(data) <= len(raw))]
    for k, byte in enumerate(data):
        begin = begin[raw[begin + k] == byte]
    row = np.searchsorted(offsets, begin, side="right") - 1
    row = row[begin + len(data) <= offsets[row + 1]]
    return row[np.diff(row, prepend=-1) > 0]


def _holding(sought: list[tuple[str, bytes | None]], counts: dict[bytes, int] | None):
    """(..., line, lower case of a line that is not all ASCII) to the rows whose line holds literals, with the entries of these."""

    def rows(batches):
        found = None
        for b in batches:
            line = pc.coalesce(b.column(b.num_columns - 1), b.column(b.num_columns - 2))
            upto = np.cumsum(pc.binary_length(line).to_numpy())
            x = 0
            while x < b.num_rows:
                y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + WORK_BYTES, side="right")))
                part, x = (x, y), y
                raw, offsets = _in_lower_case(line.slice(part[0], part[1] - part[0]))
                low = (raw & np.uint8(127)).astype(np.int32)
                codes = low[:-2] << 14 | low[1:-1] << 7 | low[2:]
                if found is None:
                    seen = np.bincount(codes, minlength=_CODES) if counts is None else None
                    found = _by_gram(sought, (lambda g: seen[_code(g)]) if counts is None else (lambda g: counts.get(g, 0)))  # noqa: B023
                held, known, short = found
                at = np.flatnonzero(known[codes])
                code = codes[at]
                order = np.argsort(code, kind="stable")
                at, code = at[order], code[order]
                first = np.flatnonzero(np.diff(code, prepend=-1))
                hits = [(e, _standing(raw, offsets, place - ahead, data)) for c, place in zip(code[first].tolist(), np.split(at, first[1:]), strict=False) for e, data, ahead in held[c]]
                hits += [(e, _standing(raw, offsets, np.flatnonzero(raw == data[0]), data)) for e, data in short]
                row = np.concatenate([np.zeros(0, np.int64), *[r for _, r in hits]])
                if not len(row):
                    continue
                entry = np.repeat(np.array([e for e, _ in hits], dtype=np.int32), [len(r) for _, r in hits])
                order = np.argsort(row, kind="stable")
                row, entry = row[order], entry[order]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(entry))
                kept = pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]).take(pa.array(part[0] + row[first]))
                yield pa.RecordBatch.from_arrays([*kept.columns, lists], names=[*kept.schema.names, "_held"])

    return rows


def _candidates(lines: DataFrame, sought: list[tuple[str, bytes | None]], counts: dict[bytes, int] | None) -> DataFrame:
    """lines (the last column is line) with entry: a row for each literal that a line has in lower case, at most once; of a literal that
    is not all ASCII, for its gram."""
    odd = F.when(F.octet_length("line") > F.char_length("line"), F.lower("line"))
    schema = T.StructType([*lines.schema.fields, T.StructField("_held", T.ArrayType(T.IntegerType()))])
    found = lines.where(F.col("line") != "").withColumn("_odd", odd).mapInArrow(_holding(sought, counts), schema)
    return found.select(*lines.columns, F.explode("_held").alias("entry"))


def _verified(found: DataFrame, keep: tuple[str, ...], silent: Column | None) -> DataFrame:
    """Candidates (with the columns of the index) that match. A line comes once for each literal of a rule that it has, and only if it has
    none of the rule's earlier literals."""
    found = found.withColumn("lower", F.lower("line"))
    where = F.when(F.col("folded"), F.col("lower")).otherwise(F.col("line"))
    found = _only(found, F.contains(where, F.col("literal")))
    goes = ~F.exists("earlier", lambda x: F.contains(where, x))
    found = _only(found, goes if silent is None else goes & ~silent).sortWithinPartitions("rule_ord")
    return _only(found, F.regexp_instr("line", F.col("pattern")) > 0).select(*keep, "line_no", "line", "rule_id", "severity", "confidence", "rule_ord")


def _only(rows: DataFrame, condition: Column) -> DataFrame:
    """rows that meet a condition, tried where it stands in the plan: as a filter it would become a part of the join with the grams,
    which with a function of arrays is no longer compiled and then copies a line for each of its bytes."""
    return rows.select("*", F.explode(F.when(condition, F.array(F.lit(True)))).alias("_kept")).drop("_kept")


def indexed_findings(lines: DataFrame, rules: list[tuple], *keep: str, silent: Column | None = None, counts: dict[bytes, int] | None = None) -> DataFrame:
    """(keep, line_no, line, rule_id, severity, confidence, rule_ord) for each line (keep, line_no, line) and rule that matches it, once.

    silent: a condition on line, lower and rule_id that keeps a rule from a line. counts: how often lines have grams; None: each
    task counts those of its first lines. A rule without literals, or with a literal that is not all ASCII and has no three
    ASCII characters in a row, is tried on every line. Null and empty lines have no findings (but for a rule without literals that matches nothing at all, on an empty line); repeated
    lines have theirs each; a very long line is looked at whole by one task; extra columns of lines
    are not carried. Without rules, or lines, there are no rows.
    """
    spark: SparkSession = lines.sparkSession
    rows, sought, rest = entries(rules)
    lines = lines.select(*keep, "line_no", "line")
    parts = []
    if rows:
        index = _small(spark.createDataFrame(rows, _RULE), len(rows))
        parts.append(_verified(_candidates(lines, sought, counts).join(index, "entry"), keep, silent))
    if rest:
        hits = []
        for k in rest:
            rule_id, severity, confidence, literals, pattern = rules[k]
            test = F.col("line").rlike(f"(?dU){pattern}")
            test = holds(F.col("line"), F.lower("line"), literals, pattern) & test if literals else test
            hits.append(F.when(test, F.struct(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(float(confidence)).alias("confidence"), F.lit(k).alias("rule_ord"))))
        plain = lines.withColumn("lower", F.lower("line")).select(*keep, "line_no", "line", "lower", F.explode(F.array_compact(F.array(*hits))).alias("r")).select(*keep, "line_no", "line", "lower", "r.*")
        parts.append((plain if silent is None else plain.where(~silent)).drop("lower").select(*keep, "line_no", "line", "rule_id", "severity", "confidence", "rule_ord"))
    if not parts:
        return lines.limit(0).select(*keep, "line_no", "line", F.lit("").alias("rule_id"), F.lit("").alias("severity"), F.lit(0.0).alias("confidence"), F.lit(0).alias("rule_ord"))
    return reduce(DataFrame.unionByName, parts)
