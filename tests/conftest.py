import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chatloom import session as S  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = S.build_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def hot(spark):
    """Every key counts as too large for one task."""
    spark.conf.set(S.SMALL_INPUT_BYTES, "0")
    spark.conf.set(S.HOT_GROUP_ROWS, "1")
    yield spark
    spark.conf.unset(S.SMALL_INPUT_BYTES)
    spark.conf.unset(S.HOT_GROUP_ROWS)


MESSAGE = "chat_id string, sender string, content string, timestamp long, type string, line_number long"


@pytest.fixture
def messages(spark):
    def make(rows):
        return spark.createDataFrame(rows, MESSAGE)

    return make
