import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from lecterna.plans.session import local, ship

    s = local(os.environ.get("TEST_CPUS", "4"), 4)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    return ship(s)


@pytest.fixture(scope="session")
def data():
    d = Path("/root/testdata/sf0.001")
    if not d.exists():
        pytest.skip("no driver tables here")
    return str(d)
