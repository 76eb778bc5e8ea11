"""Registered queries of the subpackage beyond their SQL."""

from __future__ import annotations

import os

import pytest

from codestrata.llm.queries import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES = registry.queries
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


def test_rank_errors_of_small_groups(spark):
    errors = QUERIES["p1_rank_errors"](spark, FOLDER).where("n <= 1000").collect()
    assert errors and all(r["beyond_bound"] == 0 and r["largest_rank_error"] <= 1 / r["n"] for r in errors)
