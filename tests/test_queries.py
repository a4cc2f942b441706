import pytest

from tests import oracle
from tintype.plans import catalog

@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    oracle.same(catalog.queries()[name](spark, sf_dir), duck, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    rows = catalog.queries()[name](spark, sf_dir).collect()
    assert rows
    assert all(r["status"] == "ok" for r in rows if "status" in r.asDict())


def test_entry_imports_without_llm(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tintype", tmp_path / "tintype", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    others = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != os.path.realpath(root)]
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(tmp_path), *others])}
    shutil.copytree(f"{root}/tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/bench.py", tmp_path)
    program = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() > 0
print("known", *sorted(e.queries()), "answered", *sorted(e.oracle_sql()), sep="|")
"""
    out = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    known, answered = out.stdout.strip().split("known|")[-1].split("|answered|")
    assert known.split("|") == sorted(catalog.queries()) and answered.split("|") == sorted(catalog.oracle_sql())
    found = subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests", "-p", "no:cacheprovider"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert found.returncode == 0 and "error" not in found.stdout.lower().splitlines()[-1], found.stdout
    some = "test_query_equals_sql and (clean_batch or license_ok or match_reference or image_stats-) or test_matches_inside_names"
    ran = subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_queries.py", "tests/test_grams.py", "-k", some, "-p", "no:cacheprovider"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert ran.returncode == 0 and " passed" in ran.stdout, ran.stdout
