import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gaugeframe.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[8]", 8, "8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
