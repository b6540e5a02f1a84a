from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(REPO))
os.environ["PYTHONPATH"] = os.pathsep.join([str(REPO), *filter(None, [os.environ.get("PYTHONPATH")])])  # for the workers
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

TESTDATA = Path(os.environ.get("TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from sievework.plans.session import session

    s = session(
        "tests", f"local[{min(8, os.cpu_count() or 2)}]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.driver.host": "127.0.0.1"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    where = TESTDATA / "sf0.001"
    if not where.exists():
        pytest.skip("no test data")
    return str(where)
