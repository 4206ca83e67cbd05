import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from hearthpanel.session import local_session
    session = local_session(8, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


def rows(df, *order):
    """Answer as a sorted list of tuples."""
    return sorted((tuple(r) for r in (df.select(*order) if order else df).collect()), key=repr)
