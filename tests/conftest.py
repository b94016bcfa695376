import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from recollect.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        4,
        **{
            "spark__sql__warehouse__dir": tempfile.mkdtemp(prefix="spark-"),
            "spark__driver__memory": "4g",
            "spark__sql__autoBroadcastJoinThreshold": "256k",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
