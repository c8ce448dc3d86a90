import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from changelens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("changelens-tests", cores=4)
    session.conf.set("spark.sql.shuffle.partitions", "3")
    yield session
    session.stop()


@pytest.fixture
def change(spark):
    """Facts input of one or more changes: ``change({name: code}, lines={name: n}, pr=1)``."""

    def build(files, lines=None, pr=1, repo="t/r"):
        lines = lines or {}
        rows = [(repo, pr, name, code, lines.get(name)) for name, code in files.items()]
        return spark.createDataFrame(rows, "repo STRING, pr_number LONG, filename STRING, code STRING, lines_changed LONG")

    return build
