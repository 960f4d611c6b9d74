"""Requests for records with very many tags."""

import pytest
from registry.queries import get_by_ids, items_by_address


@pytest.mark.parametrize("query", [items_by_address, get_by_ids])
def test_tags_become_text_once_for_each_record(spark, tmp_path, query):
    """As text next to a request, the tags of a record would be joined again for each of its requests."""
    events = [(i, 7 + i % 40, "view", 1.0, '{"k":1}') for i in range(200)]
    frame = spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, props string")
    frame.selectExpr("*", "timestamp'2024-01-01' as ts").write.parquet(f"{tmp_path}/events.parquet")
    docs = spark.createDataFrame([(1, "a b", "src1")], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = query(spark, str(tmp_path))
    rows = found.filter("request_id like 'e%'").collect()
    assert len(rows) == 200 and {r["tags"] for r in rows} == {",".join(sorted(f"user:{7 + i}" for i in range(40)))}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("array_join")
