"""The entry module with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(folder):
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    said = subprocess.run([sys.executable, "-c", code], cwd=folder, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ":".join(p for p in sys.path if "site-packages" in p or "dist-packages" in p)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    return [set(line.split()) for line in said.stdout.splitlines()]


def test_entry_without_the_corpus_part(tmp_path):
    shutil.copytree(ROOT / "larkspur", tmp_path / "larkspur", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    queries, oracles = names(tmp_path)
    assert len(queries) > 50 and oracles <= queries
    assert not any(n.startswith("op") or n == "pipeline" for n in queries)


def test_nothing_imports_the_corpus_part():
    for path in (ROOT / "larkspur").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
