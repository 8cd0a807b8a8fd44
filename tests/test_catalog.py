import duckdb
import pytest

from pointloom.plans import catalog

D = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda v: "" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", ["knn_cosine_top10", "knn_filter_bool_tree", "payload_null_vs_missing", "late_write_preserved", "quantized_rescore_top10", "planner_decisions", "optimizer_policy", "batch_knn", "filtered_hnsw_ef_full", "collection_search", "search_indexed", "search_indexed_range", "search_facts", "search_quantized_stored", "knn_join_blocked", "latest_by_delta", "payload_type_profile", "knn_filter_struct", "operations_in_order", "hnsw_filtered_widens", "cardinality_estimate", "knn_filter_then_exact"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    assert rows(catalog.QUERIES[name](spark, D).toPandas()) == rows(con.execute(catalog.ORACLE_SQL[name]).df())
