"""Every query of the ten problems runs on the smallest tables with its production parameters."""

import pytest

from lodeweave.llm import queries

WANTED = {
    "p1_found": ["chunk_id_a", "chunk_id_b"], "p2_found": ["chunk_id_a", "chunk_id_b"], "p3_found": ["table_name", "record_id", "line_number"], "p4_found": ["sha", "file_path"], "p5_found": ["repo_id", "file_path"],
    "p6_found": ["chunk_id", "piece_no", "first_line", "last_line"], "p7_found": ["vector_id_a", "vector_id_b"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert df.columns == WANTED.get(name, df.columns)
    n = df.count()
    assert n >= 0
    if name in WANTED and name != "p8_ids":
        assert df.distinct().count() == n
