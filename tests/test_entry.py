import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    df = e.entry(spark)
    assert df.columns == ["rgb", "idx", "d2"] and df.count() > 0


def test_works_without_the_training_data_part(tmp_path):
    shutil.copytree(ROOT / "tessella", tmp_path / "tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(n.startswith('op') and n[2].isdigit() for n in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
