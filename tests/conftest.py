from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from punctual.session import local_session

    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session(8, "tests", spark__checkpoint__dir=folder, spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from punctual.catalog.queries import Tables

    return Tables(spark, SMALL)


def rows(df, *order):
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=repr) if not order else [tuple(r) for r in df.orderBy(*order).collect()]
