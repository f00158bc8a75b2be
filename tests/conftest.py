import pytest

from tests.compare import database, session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cohortlens.session import tune
    spark = tune(session())
    if not spark.sparkContext.getCheckpointDir():
        import tempfile
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark


@pytest.fixture(scope="session")
def duck():
    return database(SMALL)
