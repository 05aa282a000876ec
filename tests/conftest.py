import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from inkprint.runtime import session

    built = session("local[8]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()
