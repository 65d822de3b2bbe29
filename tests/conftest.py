import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from settlekit.session import build_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="4g",
    )
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="settlekit-test-ckpt-"))
    yield session


@pytest.fixture(scope="session")
def small_tables(spark):
    from settlekit.sources import adapter

    return adapter.build(spark, SF001)
