import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYTHONWARNINGS", "ignore")

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__  # noqa: F401
    from framekiln.session import build_session

    session = build_session("local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture(scope="session")
def oracle():
    from workload.check import oracle_connection

    return oracle_connection(SF_DIR)


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
