import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from quire.session import get_session

    s = get_session(
        "quire-tests", master="local[8]",
        **{"spark.sql.shuffle.partitions": 4, "spark.driver.memory": "8g", "spark.sql.streaming.stopTimeout": "60s"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
