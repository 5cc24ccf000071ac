import pytest

from srcpulse.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("srcpulse-tests", cores="4", memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def values(spark):
    """``values(rows, ddl, **columns)``: rows of evaluated columns as plain tuples."""

    def run(rows, ddl, *columns):
        return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]

    return run
