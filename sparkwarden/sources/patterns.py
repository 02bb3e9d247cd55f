"""Ignore-file patterns as regular expressions: the last pattern that matches decides, '!' takes back."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_regex(pattern: str) -> tuple[str, bool] | None:
    """(regular expression over relative paths, whether it excludes) of one line; None for blanks and comments."""
    p = pattern.rstrip("\n").rstrip()
    if not p or p.startswith("#"):
        return None
    exclude = not p.startswith("!")
    p = p if exclude else p[1:]
    p = p.removeprefix("\\")
    only_dir, anchored = p.endswith("/"), "/" in p.rstrip("/")
    p, out, k = p.strip("/"), [], 0
    while k < len(p):
        if p.startswith("**/", k):
            out.append("(?:.*/)?")
            k += 3
        elif p.startswith("**", k):
            out.append(".*")
            k += 2
        elif p[k] == "*":
            out.append("[^/]*")
            k += 1
        elif p[k] == "?":
            out.append("[^/]")
            k += 1
        elif p[k] == "[" and "]" in p[k + 2 :]:
            end = p.index("]", k + 2)
            body = p[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out.append(f"[{'^' + body[1:] if body.startswith('!') else body}]")
            k = end + 1
        else:
            out.append(re.escape(p[k]))
            k += 1
    return ("^" if anchored else "^(?:.*/)?") + "".join(out) + ("/.*$" if only_dir else "(?:/.*)?$"), exclude


def compiled(patterns: list[str]) -> list[tuple[str, bool]]:
    return [x for x in map(to_regex, patterns) if x]


def matched(path: Column, patterns: list[str]) -> Column:
    """Whether the patterns, read in order, end up excluding the path."""
    def step(before: Column, rule: tuple[str, bool]) -> Column:
        return F.when(path.rlike(rule[0]), F.lit(rule[1])).otherwise(before)

    return reduce(step, compiled(patterns), F.lit(False))


def parse_list(text: str | None) -> list[str]:
    return [p.strip() for p in (text or "").split(",") if p.strip()]
