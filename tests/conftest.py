import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tessella.session import local_session, ship

    return ship(local_session(4, 4, **{"spark.driver.memory": "4g"}))


@pytest.fixture(scope="session")
def sf():
    return SF
