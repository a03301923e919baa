import pytest
from listing_cases import BASE, NOW

from gigsift.schema import LISTINGS
from gigsift.session import build_session

@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "gigsift-tests", master="local[8]", **{
            "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def now():
    return NOW


@pytest.fixture(scope="session")
def listings(spark):
    """Build a listings DataFrame: every argument changes some fields of the base row."""
    def build(*changes):
        rows = []
        for i, change in enumerate(changes):
            row = {f.name: None for f in LISTINGS.fields} | BASE | {"row_id": i} | change
            rows.append(tuple(row[f.name] for f in LISTINGS.fields))
        return spark.createDataFrame(rows, LISTINGS)
    return build
