"""Queries against their SQL; LOCIFRAME_SF names another scale."""

import os

import compare
import pytest

from lociframe.llm import queries
from lociframe.plans.registry import Question

SF_DIR = f"{compare.TESTDATA}/sf{os.environ.get('LOCIFRAME_SF', '0.001')}"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_like_sql(spark, name):
    ok, note = compare.check(spark, compare.open_duck(SF_DIR), SF_DIR, name, Question(queries.queries()[name], queries.oracle_sql()[name]))
    print(name, note)
    assert ok, note
