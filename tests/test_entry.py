"""The contract's module where optional parts are missing."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from cohortkit.plans.catalog import QUERIES

HERE = Path(__file__).resolve().parent.parent
PRINT_QUERIES = "import __spark_entry__ as e; e.oracle_sql(); print(*e.queries())"


def _queries(folder, before=""):
    done = subprocess.run(
        [sys.executable, "-c", before + PRINT_QUERIES], cwd=folder, capture_output=True, text=True, check=True
    )
    return set(done.stdout.split())


@pytest.fixture
def copied(tmp_path):
    """The library and the entry modules, without the optional subpackage."""
    shutil.copytree(HERE / "cohortkit", tmp_path / "cohortkit", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "oracles.py", "bench.py"):
        shutil.copy(HERE / name, tmp_path / name)
    return tmp_path


def test_without_the_optional_subpackage(copied):
    assert _queries(copied) == set(QUERIES)


def test_with_a_pipeline_that_finds_no_operators(copied):
    (copied / "corpus_pipeline.py").write_text("from cohortkit.llm.mixing import take\n")
    assert _queries(copied) == set(QUERIES)


def test_without_a_library_that_the_subpackage_needs():
    missing = "import sys; sys.modules['tokenizers'] = None; "
    assert set(QUERIES) <= _queries(HERE, missing)
