"""The registry must work with and without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print('NAMES', len(q), len(o), 'pipeline' in q, any(n.startswith('op') and n[2].isdigit() for n in q), set(o) <= set(q))"


def _asked(folder):
    done = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return done.stdout.split("NAMES ")[1].split()


@pytest.mark.parametrize("without", [["tickweave/llm"], ["tickweave/llm", "corpus_pipeline.py"]])
def test_queries_without_the_optional_subpackage(tmp_path, without):
    shutil.copytree(os.path.join(ROOT, "tickweave"), tmp_path / "tickweave", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    for name in without:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    queries, oracles, pipeline, numbered, covered = _asked(tmp_path)
    assert int(queries) >= int(oracles) > 80
    assert (pipeline, numbered, covered) == ("False", "False", "True")
