import pathlib
import sys

import pytest

sys.path[:0] = [str(pathlib.Path(__file__).parents[1]), str(pathlib.Path(__file__).parent)]

from tapeworks.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
