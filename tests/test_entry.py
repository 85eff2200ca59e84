import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


def test_registry_without_the_optional_parts(tmp_path):
    to = tmp_path / "repo"
    shutil.copytree(REPO, to, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not [x for x in q if x.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=to, check=True, env={**os.environ, "PYTHONPATH": str(to)}, timeout=120)


def test_nothing_else_imports_the_optional_part():
    for p in (REPO / "tallywire").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
