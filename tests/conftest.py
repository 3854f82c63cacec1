import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from veilwork.session import local_session  # noqa: E402

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("veilwork-tests", "4", 4)


@pytest.fixture(scope="session")
def sf():
    if not Path(TABLES).is_dir():
        pytest.skip("no test tables")
    return TABLES
