"""Registered queries against SQL on the smallest tables, with chunks of 64 steps."""

import pytest
from harness import check

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in SQL])
def test_matches_sql(session, name):
    session.conf.set("tidepanel.chunkRows", "64")
    try:
        assert check(session, SF, [name])[name] == ""
    finally:
        session.conf.unset("tidepanel.chunkRows")


def test_sql_keys_are_registered():
    assert set(SQL) <= set(entry.queries())


def test_entry(session):
    assert entry.entry(session).count() > 0
