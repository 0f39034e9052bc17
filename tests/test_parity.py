"""Registered queries against their SQL on the smallest tables.

A quick selection runs by default; ``QUIRE_PARITY=all`` runs every query.
"""

import os

import pytest
from parity import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUICK = (
    "vector_topk entity_ids edge_ids normalized_relations document_token_sets compacted_documents same_as_components "
    "near_duplicate_collapse hub_filtered_edges layout_components merged_components trace_rollup entity_page_ranges "
    "upserted_log trace_tumbling trace_sliding trace_sessions vector_lookup vector_topk_on_pages "
    "upserted_index loose_json_values parsed_answers expanded_pages"
).split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("QUIRE_PARITY") == "all" else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    result = compare(spark, con, name, FOLDER)
    assert result["ok"], result


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()
