"""Queries against their SQL on the smallest tables, and what each query returns."""

import glob
import os

import pytest

from gridseek.llm.queries import QUERIES, SQL

COLUMNS = {
    "op1_pii": "doc_id n_found text",
    "op2_mixing": "doc_id size source_size taken target",
    "op3_line_dedup": "doc_id n_lines n_removed text",
    "op4_decontamination": "contaminated doc_id items_sha256 n_hit n_items n_words",
    "op5_toxicity": "doc_id held_out predicted score",
    "op6_url_graph": "host page_id path rule verdict",
    "op7_suffix_dedup": "doc_id kept_sha256 n_bytes n_removed n_spans",
    "op8_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op9_near_duplicates": "component_id doc_id kept n_shingles",
    "op10_top_k": "query_id rank score vec_id",
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    assert columns == COLUMNS[name].split()
    rows = frame.collect()
    assert rows
    if name in SQL:
        duckdb = pytest.importorskip("duckdb")
        connection = duckdb.connect()
        for path in glob.glob(f"{sf_dir}/*.parquet"):
            connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
        result = connection.execute(SQL[name])
        names = [d[0] for d in result.description]
        want = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in result.fetchall())
        assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == want
