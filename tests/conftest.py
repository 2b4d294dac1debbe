import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from siftlake import session  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    return session.local(4, 4, "4g")


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.001"
