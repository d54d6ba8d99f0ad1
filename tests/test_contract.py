"""The driver's three functions, and what may import what."""

import json
import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1


def test_engine_does_not_import_the_corpus_operators():
    for p in (REPO / "chunkwise").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert not re.search(r"chunkwise\.llm|from \.+llm", p.read_text()), p


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_bench_prints_one_line():
    env = os.environ | {"BENCH_SF_DIR": SF, "BENCH_CPUS": "2", "BENCH_MEMORY": "2g", "BENCH_QUERIES": "flagship_range_sum,complib_info"}
    done = subprocess.run([sys.executable, "bench.py"], cwd=REPO, env=env, capture_output=True, text=True, timeout=300)
    line = json.loads(done.stdout.strip().splitlines()[-1])
    assert set(line) == {"metric", "value", "unit", "queries", "sf"} and set(line["queries"]) == {"flagship_range_sum", "complib_info"}
    assert all(line["queries"].values())
