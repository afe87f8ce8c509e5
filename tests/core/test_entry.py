"""The driver contract, with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[2]


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 and rows[0]["revenue"] >= rows[-1]["revenue"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_subpackage(tmp_path):
    for part in ("tessera", "__spark_entry__.py"):
        source = ROOT / part
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / part)
    shutil.rmtree(tmp_path / "tessera" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'topk' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr[-2000:]


def test_a_missing_dependency_costs_only_the_subpackage(tmp_path):
    """It is said aloud, and errors of other kinds are not hidden."""
    for part in ("tessera", "__spark_entry__.py"):
        source = ROOT / part
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / part)
    (tmp_path / "tessera" / "llm").mkdir(exist_ok=True)
    (tmp_path / "tessera" / "llm" / "__init__.py").touch()
    for line, ends in (("import a_missing_module", 0), ("1 / 0", 1)):
        (tmp_path / "tessera" / "llm" / "registry.py").write_text(f"{line}\n")
        done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'topk' in e.queries()"], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=False)
        assert done.returncode == ends and ("a_missing_module" if not ends else "ZeroDivisionError") in done.stderr
