"""The entry point with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [["millrace/llm", "tests/llm"], ["millrace/llm", "tests/llm", "corpus_pipeline.py"]])
def test_imports_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for path in gone:
        target = copy / path
        if target.is_dir():
            shutil.rmtree(target)
        elif target.exists():
            target.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k == 'pipeline' or k.startswith('op') and k[2].isdigit() for k in q), set(e.oracle_sql()) <= set(q))"
    env = os.environ | {"PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 50 and out[1:] == ["0", "True"]
