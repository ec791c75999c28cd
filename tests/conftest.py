"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from reelspark.session import session

    return session(4, 4)


@pytest.fixture
def rows():
    """Sorted tuples of a frame's columns."""

    def of(df, *cols):
        return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())

    return of
