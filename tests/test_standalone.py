"""The engine without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = """
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 80 and "pipeline" not in names and not [n for n in names if n.startswith("op") and n[2].isdigit()]
assert set(e.oracle_sql()) <= names
"""


def test_entry_without_the_subpackage(tmp_path):
    keep = shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py", "*.md", "*.json")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=keep)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "tallyline")):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert "tallyline.llm" not in f.read(), n
