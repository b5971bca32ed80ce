"""The driver contract: names, and the package without its corpus parts."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_oracles_have_queries():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_everything_else_stands_without_the_corpus_parts(tmp_path):
    shutil.copytree(f"{ROOT}/tallyfield", tmp_path / "tallyfield", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
