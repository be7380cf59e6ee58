import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tideline.session import local_session

    base = tmp_path_factory.mktemp("spark")
    session = local_session(8, "tests", **{"spark.sql.warehouse.dir": str(base / "warehouse"), "spark.checkpoint.dir": f"file://{base}/shared", "spark.sql.shuffle.partitions": "8"})
    session.sparkContext.environment["PYTHONPATH"] = str(ROOT)
    yield session
    session.stop()
