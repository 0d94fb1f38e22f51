"""The driver's contract."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry_module

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark, sf):
    df = entry_module.entry(spark)
    assert df.count() == 5
    assert df.columns[0] == "event_type"


def test_oracles_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_only_absent_modules_are_optional(tmp_path, monkeypatch):
    """A module that is there but fails to import is an error, not an absence."""
    assert entry_module._optional("no_such_module_at_all") is None
    (tmp_path / "half_there.py").write_text("import something_else_that_is_missing\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError):
        entry_module._optional("half_there")


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_the_rest_works_without_the_training_data_part(tmp_path, also):
    """Without both folders, with or without the pipeline's file, the entry imports and all other tests are collected."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for gone in ("quarry/llm", "tests/llm", *also):
        path = copy / gone
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    code = "import __spark_entry__ as e, quarry.plans.catalog as c; assert set(e.queries()) == set(c.QUERIES) and set(e.oracle_sql()) == set(c.ORACLE)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=120)
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stdout
