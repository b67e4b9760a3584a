import pytest

from tickspark.session import local_session

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def gap_rows(spark):
    """Two-tick bars of the supplied events, written once."""
    from catalog.base import gap_bars
    from tickspark.session import materialize

    return materialize(gap_bars(spark, SF), "test-gap-bars")


@pytest.fixture(scope="session")
def bar_rows(spark):
    from catalog.base import bars
    from tickspark.session import materialize

    return materialize(bars(spark, SF), "test-bars")
