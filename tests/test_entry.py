"""The registry does not depend on the packages of the training-data operators."""

import os
import subprocess
import sys

import pytest


@pytest.mark.parametrize("missing", ["zstandard", "xxhash", "tesserine.llm", "corpus_pipeline"])
def test_queries_without_a_package(missing):
    code = f"""import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as e
names = set(e.queries())
assert "risk_score" in names and "dep_cycles" in names and set(e.oracle_sql()) <= names
print(len(names))"""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=top)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 153
