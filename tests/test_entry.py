import shutil
import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).resolve().parent.parent
CORE_ONLY = "import __spark_entry__ as e; from keyfold.queries import CATALOGUE; assert set(e.queries()) == set(e.oracle_sql()) == set(CATALOGUE)"


def test_entry_without_the_training_data_operators(tmp_path):
    shutil.copytree(TOP / "keyfold", tmp_path / "keyfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(TOP / "__spark_entry__.py", tmp_path)
    subprocess.run([sys.executable, "-c", CORE_ONLY], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"}, check=True)


def test_entry_without_a_library_that_they_need():
    code = f"import sys; sys.modules['xxhash'] = None; {CORE_ONLY}"
    subprocess.run([sys.executable, "-c", code], cwd=TOP, env={"PYTHONPATH": str(TOP), "PATH": "/usr/bin"}, check=True)


def test_nothing_else_imports_them():
    others = [p for p in (TOP / "keyfold").rglob("*.py") if "llm" not in p.parts]
    assert others and not [p for p in others if "keyfold.llm" in p.read_text() or "corpus_pipeline" in p.read_text()]
