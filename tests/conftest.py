import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    from scarp.session import local_session

    session = local_session(4, app="scarp-tests", **{"spark.sql.shuffle.partitions": "3", "scarp.hotRows": "1", "scarp.chunkRows": "20"})
    yield session
    session.stop()
