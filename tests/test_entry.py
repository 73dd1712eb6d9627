from __future__ import annotations

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_contract_needs_no_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 40 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=REPO, check=True)


def test_contract_without_training_data_operators(tmp_path):
    """Without the subpackage and the pipeline, the other queries are there."""
    import shutil

    shutil.copytree(REPO / "payloom", tmp_path / "payloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 40 and not any(x.startswith('op') for x in e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


def test_the_rest_passes_without_training_data_operators(tmp_path):
    """Without the subpackage, its tests and the pipeline, the other tests are found and run."""
    import shutil

    for name in ("payloom", "tests"):
        shutil.copytree(REPO / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    subprocess.run([sys.executable, "-B", "-m", "pytest", "tests", "-q", "-p", "no:cacheprovider", "-k", "(resolve or selection or matrix or needs_no_session) and not cli"], cwd=tmp_path, check=True)


def test_the_engine_is_there_without_a_package_of_the_operators(tmp_path):
    """A package that only the training-data operators need may be missing; that is logged."""
    import shutil

    shutil.copytree(REPO / "payloom", tmp_path / "payloom", ignore=shutil.ignore_patterns("__pycache__"))
    for path in (REPO / "__spark_entry__.py", REPO / "corpus_pipeline.py"):
        if path.exists():
            shutil.copy(path, tmp_path)
    (tmp_path / "xxhash.py").write_text("raise ModuleNotFoundError('no xxhash', name='xxhash')")
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 40 and not any(x.startswith('op') for x in e.queries())"
    told = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stderr
    assert "left out" in told


def test_entry(spark):
    import __spark_entry__

    if Path(__spark_entry__.ENTRY_DIR).exists():
        rows = __spark_entry__.entry(spark).collect()
        assert {r.keyword for r in rows} >= {"enum", "minimum", "maximum"}
