import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def spark():
    from cairnstore.session import session

    s = session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
