from __future__ import annotations

import os
import sys
import uuid
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tablework.session import local_session  # noqa: E402

TESTDATA = os.environ.get("TABLEWORK_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    home = tmp_path_factory.mktemp("spark")
    session = local_session(
        8,
        8,
        **{
            "spark.checkpoint.dir": str(home / "checkpoint"),
            "spark.sql.warehouse.dir": str(home / "warehouse"),
        },
    )
    yield session
    session.stop()


@pytest.fixture
def name():
    """A table name that is not in use."""
    return f"t_{uuid.uuid4().hex}"


@pytest.fixture(scope="session")
def folder():
    return f"{TESTDATA}/sf0.01"
