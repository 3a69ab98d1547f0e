"""The library and its entry work when the training-data subpackage and the pipeline are gone."""
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CHECK = """
import __spark_entry__ as entry
names, sql = entry.queries(), entry.oracle_sql()
assert not any(n.startswith("op") and n[2:3].isdigit() for n in names), sorted(names)
assert "pipeline" not in names and set(sql) <= set(names)
print(len(names))
"""


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_entry_without_corpus_subpackage(tmp_path, pipeline_too):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.txt", "llm"))
    if pipeline_too:
        (copy / "corpus_pipeline.py").unlink()
    assert not (copy / "tallyloom" / "llm").exists()
    done = subprocess.run([sys.executable, "-c", CHECK], cwd=copy, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) > 100
