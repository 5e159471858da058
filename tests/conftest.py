import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from revwatch.session import build_session  # noqa: E402

SF_DIR = os.environ.get("REVWATCH_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "revwatch-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SF_DIR).is_dir():
        pytest.skip(f"{SF_DIR} is absent")
    return SF_DIR


@pytest.fixture(scope="session")
def warehouse(spark, sf_dir):
    from revwatch.plans.warehouse import open_warehouse

    return open_warehouse(spark, sf_dir)
