"""The registered queries on the smallest test data: the columns that are fixed, and SQL where there is some."""

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op2": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], "op4": ["page_id", "url", "text", "n_chars"], "op5": ["query_id", "rank", "vec_id", "score"],
    "op6": ["doc_id", "n_shingles", "component_id", "kept"], "op7": ["doc_id", "held_out", "lang_pred", "score"],
    "op9": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], "op10": ["doc_id", "held_out", "score", "predicted"],
    "op11": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op12": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    "op13": ["doc_id", "n_words", "n_removed", "kept_sha256"],
}


@pytest.mark.parametrize("name", [x for x in queries() if x.startswith("op") and x.split("_")[0][2:].isdigit()])
def test_query(spark, name):
    df = queries()[name](spark, FOLDER)
    fixed = COLUMNS.get(name.split("_")[0])
    assert fixed is None or df.columns[:len(fixed)] == fixed
    if name in oracle_sql():
        assert compare(df, connect(FOLDER), oracle_sql()[name]) == ""
    else:
        df.count()


def test_all_dealt_queries():
    names = {x.split("_")[0] for x in queries()}
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} <= names
