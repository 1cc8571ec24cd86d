"""Every query of the subpackage runs on whole tables; those with SQL give what it gives."""

import pytest
from oracle import DATA, connect, rows_of_spark, rows_of_sql

from shelfmark.llm.queries import QUERIES, SQL

COLUMNS = {
    "p1_found": [("first_id", "bigint"), ("copy_id", "bigint")],
    "p2_found": [("track_id", "bigint"), ("genre_id", "bigint")],
    "p4_found": [("name_a", "string"), ("name_b", "string")],
    "p6_found": [("track_id", "bigint"), ("tag_name", "string"), ("plain_text", "string")],
    "p7_found": [("track_id", "bigint"), ("tag_name", "string"), ("restored", "string")],
    "p8_ids": [("doc_id", "bigint"), ("ids", "array<bigint>")],
    "p9_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p10_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert name not in COLUMNS or df.dtypes == COLUMNS[name]
    got = rows_of_spark(df)
    assert len(got) == len(set(got)) or name == "p1_ledger" or name == "p8_ids"
    if name in SQL:
        assert got == rows_of_sql(connect(), SQL[name], df.columns)
