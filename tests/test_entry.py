"""The entry module with and without the optional corpus queries."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as e

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_corpus_queries(tmp_path):
    """A copy without the corpus subpackage still offers every screen query."""
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        # Left behind alone, it isn't imported.
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    shutil.copytree(f"{ROOT}/loomscreen", tmp_path / "loomscreen", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(f"{ROOT}/jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_corpus_queries_that_cannot_be_imported(tmp_path):
    """Where a library of the corpus subpackage is missing, a warning says so and the screen queries stay."""
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    for name in ("loomscreen", "jobs"):
        shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "loomscreen" / "llm").mkdir()
    (tmp_path / "loomscreen" / "llm" / "__init__.py").write_text("")
    (tmp_path / "loomscreen" / "llm" / "queries.py").write_text("import a_library_that_is_not_there\n")
    code = "import warnings\nwith warnings.catch_warnings(record=True) as w:\n    warnings.simplefilter('always')\n    import __spark_entry__ as e\nassert len(e.queries()) > 150 and any('a_library_that_is_not_there' in str(x.message) for x in w)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
