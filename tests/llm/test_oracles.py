"""The training-data queries that SQL can express, against it."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import database, same  # noqa: E402

from gridspan.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, sf, name):
    same(spark, database(sf), queries.QUERIES[name], queries.ORACLES[name], sf)


def test_near_dedup_equals_brute_force(spark, sf):
    from gridspan.llm.common import table
    from llm_brute import brute_components

    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    expected, sizes = brute_components(rows, 2)
    for r in queries.op4_near_dedup(spark, sf).collect():
        assert (r.component_id, r.n_shingles, r.kept) == (expected[r.doc_id], sizes[r.doc_id], r.doc_id == expected[r.doc_id])


def test_url_and_licence_queries_run_whole(spark, sf):
    from gridspan.llm.common import table

    assert queries.op5_url_filter(spark, sf).count() == table(spark, sf, "pages").count()
    assert queries.op1_license_scan(spark, sf).where("family IS NULL").count() == 0
