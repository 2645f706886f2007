"""Registered queries against their SQL on the smallest given tables."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

from tests.check_oracle import compare, connect

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables not found")


def catalog():
    from logweir.catalog import load

    return load()


@pytest.fixture(scope="module")
def connection():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(catalog()))
def test_query_agrees_with_its_sql(spark, connection, name):
    query = catalog()[name]
    assert query.sql is not None
    assert compare(spark, connection, name, query.run, query.sql, DATA) is None


def test_entry_runs_from_elsewhere_and_without_the_package_on_the_workers(tmp_path):
    script = (
        "import importlib.util, sys\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[4]').config('spark.ui.enabled', 'false')"
        ".config('spark.sql.shuffle.partitions', '4').getOrCreate()\n"
        f"spec = importlib.util.spec_from_file_location('entry', r'{ROOT / '__spark_entry__.py'}')\n"
        "module = importlib.util.module_from_spec(spec)\n"
        "spec.loader.exec_module(module)\n"
        "print('rows', module.entry(spark).count())\n"
    )
    env = {key: value for key, value in os.environ.items() if key != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 15" in done.stdout, done.stderr[-2000:]
