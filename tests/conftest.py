import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from consigna.schema import RAW_ROWS, RAW_TEXTS  # noqa: E402
from consigna.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = build(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(folder),
            "spark.sql.warehouse.dir": str(folder / "warehouse"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def grid(spark):
    """Sheet rows from {file: [(sheet name, rows)]}."""
    def make(files):
        data = []
        for file_id, sheets in files.items():
            if not sheets:
                data.append((file_id, None, None, None, None))
            for s, (name, rows) in enumerate(sheets):
                if not rows:
                    data.append((file_id, s, name, None, None))
                data += [
                    (file_id, s, name, r, None if cells is None else [None if c is None else str(c) for c in cells])
                    for r, cells in enumerate(rows)
                ]
        return spark.createDataFrame(data, RAW_ROWS)
    return make


@pytest.fixture(scope="session")
def pages(spark):
    """Text pages from {file: [page, ...]}."""
    def make(files, kind="pdf"):
        data = [(f, kind, i, t) for f, ps in files.items() for i, t in enumerate(ps)]
        return spark.createDataFrame(data, RAW_TEXTS)
    return make
