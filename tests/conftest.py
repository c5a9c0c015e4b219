import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("PALISADE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from palisade.session import build_session

    session = build_session(
        "tests", cores="8",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.sql.ui.retainedExecutions": "1"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def lines(spark, tmp_path):
    """Write texts as the files of a folder and give its path."""

    def write(files: dict[str, str]):
        for name, text in files.items():
            (tmp_path / name).write_bytes(text.encode() if isinstance(text, str) else text)
        return str(tmp_path)

    return write
