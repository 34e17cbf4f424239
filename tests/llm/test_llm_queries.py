"""The registered queries of the subpackage that SQL can state."""

import pytest

from cases import SCHEMA, rows

from feedloom.llm import queries
from feedloom.plans.compare import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf, name):
    same, what = compare(spark, queries.QUERIES[name], queries.ORACLES[name], sf)
    assert same, what


#: Queries of other tables have awkward ones of their own in their tests.
OF_DOCUMENTS = sorted(set(queries.ORACLES) - {"op11_prefix_trie", "op12_contamination"})


@pytest.mark.parametrize("name", OF_DOCUMENTS)
@pytest.mark.parametrize("most", [None, 1])
def test_query_on_awkward_tables(spark, tmp_path, name, most):
    """Nulls, ties, repeated rows, a very long text; and a table of one row."""
    made = rows()[:most]
    if name == "op1_quality_rules":  # its SQL tells documents apart by doc_id; the operator doesn't
        made = [(i, *r[1:]) for i, r in enumerate(made)]
    spark.createDataFrame(made, SCHEMA).repartition(2).write.parquet(f"file://{tmp_path}/documents.parquet")
    same, what = compare(spark, queries.QUERIES[name], queries.ORACLES[name], str(tmp_path))
    assert same, what
