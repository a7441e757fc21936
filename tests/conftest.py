import pytest

from opsloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


def rows(df):
    return sorted(tuple(r) for r in df.collect())
