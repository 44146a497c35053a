"""One small session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from brindle.session import local_session

    at = tmp_path_factory.mktemp("shared")
    s = local_session(4, "3g", 4, **{"spark.checkpoint.dir": f"file://{at}", "spark.sql.warehouse.dir": f"{at}/warehouse"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SF
