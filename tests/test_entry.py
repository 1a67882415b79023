"""The driver's contract without the optional parts."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; from stratalog.queries import QUERIES; print(sorted(set(e.queries()) - set(QUERIES)), set(e.oracle_sql()) <= set(e.queries()))"


def extra(folder):
    out = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert out.returncode == 0, out.stderr
    return out.stdout.strip().splitlines()[-1]


def test_the_entry_works_without_the_optional_folders(tmp_path):
    keep = shutil.ignore_patterns("llm", "__pycache__", ".git", "tests")
    shutil.copytree(ROOT, tmp_path / "a", ignore=keep)
    assert extra(tmp_path / "a") == "[] True"
    (tmp_path / "a/stratalog/llm").mkdir()  # an empty folder that is left behind
    assert extra(tmp_path / "a") == "[] True"
    (tmp_path / "a/stratalog/llm").rmdir()
    if os.path.exists(tmp_path / "a/corpus_pipeline.py"):
        os.remove(tmp_path / "a/corpus_pipeline.py")
    assert extra(tmp_path / "a") == "[] True"


def test_a_fault_inside_them_is_not_hidden(tmp_path):
    shutil.copytree(ROOT, tmp_path / "a", ignore=shutil.ignore_patterns("llm", "__pycache__", ".git", "tests"))
    (tmp_path / "a/corpus_pipeline.py").write_text("import no_such_module_at_all\n")
    out = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=tmp_path / "a", capture_output=True, text=True)
    assert out.returncode and "no_such_module_at_all" in out.stderr
