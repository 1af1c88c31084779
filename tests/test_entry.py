"""The entry points work without the training-data part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); print(len([n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline']))"


def _run(folder):
    return subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)})


def test_without_the_training_data_part(tmp_path):
    shutil.copytree(os.path.join(ROOT, "usagelake"), tmp_path / "usagelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    done = _run(tmp_path)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[-1] == "0"


def test_other_tests_stand_without_it(tmp_path):
    """All of them can be collected with both folders gone, and a quick part of them passes."""
    for folder in ("usagelake", "tests"):
        shutil.copytree(os.path.join(ROOT, folder), tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    for what in (["--collect-only", "tests"], ["tests/test_plans.py"]):
        done = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *what], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
        assert done.returncode == 0, done.stdout[-2000:]


def test_nothing_imports_it():
    for folder, _, names in os.walk(os.path.join(ROOT, "usagelake")):
        if os.path.basename(folder) != "llm":
            for name in (n for n in names if n.endswith(".py")):
                with open(os.path.join(folder, name)) as f:
                    assert "llm" not in f.read()
