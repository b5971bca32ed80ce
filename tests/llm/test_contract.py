"""Shapes of the registered queries over the smallest tables."""

import duckdb
import pytest

from tallyfield.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id held_out lang_pred score",
    2: "doc_id n_words n_hit n_items items_sha256 contaminated",
    4: "doc_id held_out n_tokens n_known train_tokens base_score score",
    5: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    6: "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    7: "doc_id n_bytes n_tokens over_limit",
    9: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    10: "doc_id fingerprint component_id",
    11: "anchor_id positive_id rank negative_id positive_score negative_score",
    12: "doc_id held_out score predicted",
    13: "item_id rank doc_id score",
}


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert ORACLE_SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_whole_table(spark, name):
    df = QUERIES[name](spark, DIR)
    n = int(name[2:].split("_")[0])
    want = COLUMNS.get(n, "").split()
    assert df.columns[: len(want)] == want
    rows = df.collect()
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    if n == 3:
        assert len(rows) == spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id").distinct().count()
    elif n in (11, 13):
        con = duckdb.connect()
        for t in ("embeddings", "documents", "benchmark"):
            con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
        assert rows and sorted(map(tuple, rows)) == sorted(con.execute(ORACLE_SQL[name]).fetchall())
    elif n == 9:
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    else:
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    if n == 1:
        truth = {r.doc_id: r.lang for r in docs.collect()}
        tried = [r for r in rows if r.held_out]
        assert sum(r.lang_pred == truth[r.doc_id] for r in tried) >= 0.95 * len(tried)
    if n == 4:
        tried = [r for r in rows if r.held_out]
        assert sum(r.score for r in tried) > sum(r.base_score for r in tried)
