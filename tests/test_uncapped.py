"""Queries whose SQL has no limit cut nothing; None stands for no limit."""

import pytest

from sessionlake.operators import filters, search, transcripts
from sessionlake.plans import catalog

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["session_list_summaries", "match_counts", "score_normalise"])
def test_no_cut_in_plan(spark, name):
    plan = catalog.QUERIES[name](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "row_number" not in plan and "<= 1000" not in plan


def test_none_is_no_limit(spark):
    sessions = spark.range(1500).selectExpr("id", "timestamp_seconds(id) AS ts_start")
    rows = filters.session_list(sessions, None, 2).collect()
    assert [r.id for r in rows] == list(range(1497, -1, -1)) and filters.session_list(sessions).count() == 1000
    scored = spark.range(1500).selectExpr("1 AS qid", "id AS session_id", "id AS doc", "id * 1.0D AS score")
    assert search.best_of_sessions(scored, None).count() == 1500 and search.best_of_sessions(scored, 10).count() == 10
    messages = spark.range(60).selectExpr("1 AS session_id", "id AS message_id", "id AS seq", "'user' AS role", "'a line' AS content")
    assert transcripts.line_hits(messages, "line", most=None).count() == 60 and transcripts.line_hits(messages, "line").count() == 50
