import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from sievemark.session import get_spark

    s = get_spark("4", 4, "tests", **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.streaming.stateStore.maintenanceInterval": "600s"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
