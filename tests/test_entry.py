"""The entry file with the text operators, and in a copy of the repository without them."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

HOME = Path(__file__).parent.parent
CHECK = """
import __spark_entry__ as entry
from granary.plans import catalogue
assert set(entry.queries()) == set(catalogue.queries()) and set(entry.oracle_sql()) == set(catalogue.ORACLE_SQL), set(entry.queries()) ^ set(catalogue.queries())
"""


def run(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}, check=False)


def test_without_the_text_operators(tmp_path):
    for pipeline in (True, False):
        copy = tmp_path / str(pipeline)
        shutil.copytree(HOME, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse", *([] if pipeline else ["corpus_pipeline.py"])))
        done = run(copy, CHECK)
        assert done.returncode == 0, done.stderr
        tests = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests", "--ignore=tests/test_entry.py"], cwd=copy, capture_output=True, text=True, timeout=300, check=False)
        assert tests.returncode == 0, tests.stdout


def test_errors_inside_the_text_operators_are_not_hidden(tmp_path):
    shutil.copytree(HOME / "granary", tmp_path / "granary", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(HOME / "__spark_entry__.py", tmp_path)
    (tmp_path / "granary" / "llm").mkdir()
    (tmp_path / "granary" / "llm" / "__init__.py").touch()
    (tmp_path / "granary" / "llm" / "registry.py").write_text("import a_module_that_is_not_there")
    assert "a_module_that_is_not_there" in run(tmp_path, "import __spark_entry__; __spark_entry__.queries()").stderr
