import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from sylvagraph.session import local_session

    session = local_session(4, 4, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    from sylvagraph.sources.tables import TABLE_NAMES

    connection = duckdb.connect()
    for name in TABLE_NAMES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def rows(frame):
    """Rows of a pandas frame, columns by name, in a fixed order."""
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(tuple("~" if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))
