"""Queries run over all symbols: a choice of ids appears in neither a query nor its SQL."""

import inspect
import re

import pytest

from tidebar import queries

#: Where an id decides a value, not whether a row is read.
VALUES = {"remaining_dates_anti", "backfilled_dates_intersect"}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_no_choice_of_symbols(name):
    where = re.compile(r"WHERE (symbol|user_id|l_suppkey)\s*(%|<|>|=|<=|>=|IN)\s*\(?\d", re.IGNORECASE)
    assert name in VALUES or not where.search(queries.ORACLE_SQL[name])


def test_no_query_filters_ids():
    source = inspect.getsource(queries)
    assert not re.search(r"where\([\"']symbol <= ", source)
