import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from lodestone.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, app="tests", memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def rows():
    def read(df, *cols):
        out = df.select(*cols) if cols else df
        return sorted(tuple(r) for r in out.collect())

    return read
