import pytest

from resurvey.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 3)
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples."""

    def get(df, *cols):
        picked = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return get
