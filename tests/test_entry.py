"""The driver's contract holds with and without the training-data subpackage."""

import sys

import pytest

import __spark_entry__
from pressroom import queries as core


def test_without_the_subpackage(monkeypatch):
    """Its absence, or that of a library that it needs, leaves the news queries."""
    monkeypatch.setitem(sys.modules, "pressroom.llm.queries", None)
    with pytest.warns(UserWarning, match="left out"):
        assert __spark_entry__.queries() == core.QUERIES
    with pytest.warns(UserWarning, match="left out"):
        assert __spark_entry__.oracle_sql() == core.ORACLE_SQL


def test_every_sql_has_its_query():
    assert core.ORACLE_SQL.keys() <= core.QUERIES.keys()


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["cluster", "article_count", "importance_score", "representative_id"]
