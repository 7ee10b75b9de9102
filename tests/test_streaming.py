"""A streaming sink that publishes each batch once."""

from sessionlake.operators.kept import Tables
from sessionlake.operators.packing import scratch
from sessionlake.streaming import counters


def test_a_batch_given_again_changes_nothing(spark):
    tables, schema = Tables(spark, scratch(spark)), "session_id long, seq long, content string"
    sink = counters.session_sink(tables, "messages", "s")
    rows = lambda: sorted(tuple(r) for r in tables.read("messages").collect())
    sink(spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], schema), 0)
    files, run = tables.files("messages"), tables.state()["run"]
    sink(spark.createDataFrame([(1, 0, "other")], schema), 0)
    assert tables.files("messages") == files and tables.state()["run"] == run
    sink(spark.createDataFrame([(1, 0, "z"), (3, 0, "d")], schema), 1)
    sink(spark.createDataFrame([(1, 0, "z"), (3, 0, "d")], schema), 1)
    assert rows() == [(1, 0, "z"), (2, 0, "c"), (3, 0, "d")]
    sink(spark.createDataFrame([], schema), 2)
    counters.session_sink(tables, "messages", "other")(spark.createDataFrame([(2, 0, "e")], schema), 0)
    assert rows() == [(1, 0, "z"), (2, 0, "e"), (3, 0, "d")] and tables.state()["batches"] == {"s": 2, "other": 0}
