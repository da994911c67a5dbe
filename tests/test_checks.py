"""Every query against its SQL on the smallest tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from lakechecks.compare import connect, normal
from lakechecks.oracles import ORACLES
from lakechecks.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 100
    assert [r["position"] for r in rows] == list(range(len(rows)))


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = connect(FOLDER).execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, pipeline):
    root = Path(entry.__file__).resolve().parent
    for name in ("logmere", "lakechecks"):
        shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * pipeline:
        shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(REGISTRY)), str(len(ORACLES))], done.stderr
