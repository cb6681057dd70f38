"""Every query with SQL gives the SQL's rows; the others run and give rows."""

import pytest

from terrasheet.plans import ORACLES, QUERIES

from .oracle import connect, differences


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, data, con, name):
    assert differences(QUERIES[name](spark, data), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_does_not_need_the_corpus_part():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "terrasheet"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"(from|import) .*\bllm\b", p.read_text()), p
