"""The registry, also without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

TOP = Path(__file__).resolve().parent.parent
SCRIPT = """
import __spark_entry__ as e
names = set(e.queries())
assert set(e.oracle_sql()) <= names, "SQL without a query"
print(len(names), sum(n.startswith("op") and n[2].isdigit() for n in names), "pipeline" in names)
"""


def test_every_sql_text_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [["opsloom/llm"], ["opsloom/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_the_training_data_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(TOP, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", *(Path(g).name for g in gone)))
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    count, numbered, pipeline = done.stdout.split()
    assert int(count) > 200 and pipeline == "False"
    assert int(numbered) == 0 or "opsloom/llm" not in gone
