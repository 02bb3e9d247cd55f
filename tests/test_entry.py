"""The driver contract with and without the optional corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOOK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_corpus_operators(tmp_path, pipeline):
    shutil.copytree(f"{HERE}/sparkwarden", tmp_path / "sparkwarden", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py", *["corpus_pipeline.py"] * (pipeline and os.path.exists(f"{HERE}/corpus_pipeline.py"))):
        shutil.copy(f"{HERE}/{name}", tmp_path / name)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", LOOK], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, ops, listed = out.stdout.split()
    assert int(n) > 90 and ops == "0" and listed == "False"


def test_other_import_errors_surface(tmp_path):
    shutil.copytree(f"{HERE}/sparkwarden", tmp_path / "sparkwarden", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "sparkwarden/llm").mkdir()
    (tmp_path / "sparkwarden/llm/__init__.py").write_text("")
    (tmp_path / "sparkwarden/llm/queries.py").write_text("import no_such_module_at_all\n")
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    out = subprocess.run([sys.executable, "-c", LOOK], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode != 0 and "no_such_module_at_all" in out.stderr


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, names in os.walk(f"{HERE}/sparkwarden"):
        if "llm" not in folder.split(os.sep):
            for name in (n for n in names if n.endswith(".py")):
                with open(os.path.join(folder, name)) as f:
                    assert "sparkwarden.llm" not in f.read(), name
