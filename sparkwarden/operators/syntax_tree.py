"""Rules over Python syntax trees. The tree has no JVM form, so this is the one detector that runs in Python."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.catalog import TREE_RULES

# --- fixed values: names and calls that the rules look for ---
SECRET_NAMES = {
    "password", "passwd", "pwd", "secret", "api_key", "apikey", "api_secret", "apisecret", "auth_token", "authtoken", "access_key", "secret_key",
    "private_key", "encryption_key", "jwt_secret", "session_secret", "consumer_secret", "db_password", "db_passwd",
}
CLIENTS, TIMED, VERIFIED = {"requests", "httpx"}, {"get", "post", "put", "patch", "delete", "head"}, {"get", "post", "put", "patch", "delete", "head", "request"}

_DDL = "file_path string, line_no int, rule_id string, severity string, confidence double, snippet string, function string"


class _Visitor(ast.NodeVisitor):
    """Collects (line, rule, snippet, innermost function)."""

    def __init__(self, source: str):
        self.source, self.inside, self.found = source, [""], []

    def add(self, node: ast.AST, rule: str, snippet: str | None = None) -> None:
        text = (ast.get_source_segment(self.source, node) or "") if snippet is None else snippet
        self.found.append((node.lineno, rule, text[:80], self.inside[-1]))

    def visit_FunctionDef(self, node) -> None:
        self.inside.append(node.name)
        self.generic_visit(node)
        self.inside.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Assign(self, node: ast.Assign) -> None:
        if isinstance(node.value, ast.Constant) and len(str(node.value.value)) >= 8:
            for t in node.targets:
                if isinstance(t, ast.Name) and t.id.lower() in SECRET_NAMES:
                    self.add(node, "SAF-HARDCODED-CRED")
        self.generic_visit(node)

    def visit_ExceptHandler(self, node: ast.ExceptHandler) -> None:
        if node.type is None and [type(x) for x in node.body] == [ast.Pass]:
            self.add(node, "SAF-BARE-EXCEPT", "except:")
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in CLIENTS:
            given = {k.arg: k.value for k in node.keywords if k.arg}
            if f.attr in TIMED and "timeout" not in given:
                self.add(node, "SAF-REQUEST-TIMEOUT")
            if f.attr in VERIFIED and isinstance(v := given.get("verify"), ast.Constant) and v.value is False:
                self.add(node, "SAF-INSECURE-SSL")
        self.generic_visit(node)


def scan_source(source: str | None) -> list[tuple[int, str, str, str]]:
    """(line, rule, snippet, function) of a module's source, by line; none if it does not parse."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    visitor = _Visitor(source or "")
    try:
        visitor.visit(tree)
    except RecursionError:
        return []
    return sorted(visitor.found)


def tree_findings(files: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """One row per finding in the Python files among files(path, content); other files never leave the JVM."""
    def run(batches):
        for b in batches:
            rows = [(p, line, rule, *TREE_RULES[rule], text, inside) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for line, rule, text, inside in scan_source(c)]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in _DDL.split(", ")])

    python = files.where(F.col(path).endswith(".py")).select(F.col(path).cast("string"), F.col(content).cast("string"))
    return python.mapInArrow(run, _DDL)
