import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from check import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, partitions=2)
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_points(spark):
    def make(vectors, ids=None, groups=None):
        rows = []
        for i, v in enumerate(vectors):
            id = i if ids is None else int(ids[i])
            rows.append((id, 0.0, [float(x) for x in v], 0 if groups is None else int(groups[i])))
        return spark.createDataFrame(rows, "id bigint, label double, features array<double>, group_id int")

    return make


@pytest.fixture(scope="session")
def line(make_points):
    """Six points on a line, ids 0 to 5."""
    return make_points([[0], [1], [3], [6], [10], [15]], groups=[0, 1, 0, 1, 0, 1])
