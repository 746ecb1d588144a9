"""The driver's contract, and every query of the library against DuckDB at the smallest scale."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from pathloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
#: Searches take rounds of jobs; the route queries share one search, so one of them stands for all here.
SLOW = {"route_sssp_walking_night", "route_steps", "route_hazards", "routes", "route_explanations", "route_geometry", "routes_avoiding", "route_outcomes", "routes_recalculated"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", [n for n in catalog.ORACLES if n not in SLOW])
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 25  # one for each request
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_without_the_text_part(tmp_path, pipeline_stays):
    root = Path(__spark_entry__.__file__).parent
    copy = tmp_path / "copy"
    left_out = [".git", "llm", "__pycache__"] + ([] if pipeline_stays else ["corpus_pipeline.py"])
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(*left_out))
    code = "import __spark_entry__ as e; from pathloom.plans import catalog; assert set(e.queries()) == set(catalog.QUERIES) and set(e.oracle_sql()) == set(catalog.ORACLES)"
    # The child finds what this process finds, but this library only in the copy.
    paths = os.pathsep.join([str(copy), *(p for p in sys.path if p and Path(p).resolve() != root.resolve())])
    child = {"cwd": copy, "check": True, "env": {**os.environ, "PYTHONPATH": paths}}
    subprocess.run([sys.executable, "-c", code], **child)
    rest = ["tests/test_sources.py"] if pipeline_stays else ["--collect-only", "tests"]
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *rest], **child)


def test_library_does_not_import_the_text_package():
    for name in [n for n in sys.modules if n.startswith("pathloom") and ".llm" not in n]:
        source = Path(sys.modules[name].__file__).read_text()
        assert "pathloom.llm" not in source
