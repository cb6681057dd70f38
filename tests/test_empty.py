"""Every query runs on empty tables."""

import pyarrow.parquet as pq
import pytest

from terrasheet.plans import QUERIES

from .oracle import TABLES


@pytest.fixture(scope="module")
def nothing(data, tmp_path_factory):
    to = tmp_path_factory.mktemp("nothing")
    for t in TABLES:
        pq.write_table(pq.read_table(f"{data}/{t}.parquet").slice(0, 0), to / f"{t}.parquet")
    return str(to)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, nothing, name):
    QUERIES[name](spark, nothing).collect()
