import pytest
from pyspark.sql import functions as F

from lakemill.llm.chat import OP8_SQL, format_reply_trees, from_turns, op8_format_chats, read_loss_text, read_turns

TREE = "tree long, node long, parent long, role string, text string, score double"


def test_best_branch(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "thanks", 0.5), (1, 5, 2, "user", "no", 0.9), (2, 1, None, "user", "alone", None)]
    got = {(r.tree, r.leaf): r for r in format_reply_trees(spark, spark.createDataFrame(rows, TREE)).withColumn("turns", read_turns(F.col("formatted"))).collect()}
    assert [t.text for t in got[1, 4].turns] == ["q", "good", "thanks"] and set(got) == {(1, 4), (2, 1)}
    both = format_reply_trees(spark, spark.createDataFrame(rows, TREE), branches=2)
    assert {(r.tree, r.leaf) for r in both.collect()} == {(1, 4), (1, 5), (2, 1)}


def test_round_trip(spark):
    hard = ["<|im_end|>", "<\\|", "\\", "a\\\\<|b", "<|im_start|>assistant\nok<|im_end|>\n", "", None, "<", "|im_end|>", "😀 é\n\n"]
    rows = [(1, k + 1, k or None, ["user", "assistant", "odd\nrole", None][k % 4], t, 0.0) for k, t in enumerate(hard)]
    got = format_reply_trees(spark, spark.createDataFrame(rows, TREE)).select(read_turns(F.col("formatted")).alias("t"), read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).first()
    assert [(t.role, t.text) for t in got.t] == [(r or "", t or "") for _, _, _, r, t, _ in rows]
    assert got.l == "".join(t or "" for _, _, _, r, t, _ in rows if r == "assistant")


def test_edges(spark):
    assert format_reply_trees(spark, spark.createDataFrame([], TREE)).count() == 0
    cycle = [(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0), (2, 1, 9, "user", "orphan", 0.0)]
    assert [r.tree for r in format_reply_trees(spark, spark.createDataFrame(cycle, TREE)).collect()] == [2]
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", None), (None, 0, None, "x")] + [(3, k, "user", str(k)) for k in range(70)]
    talks = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.tree: r.t for r in format_reply_trees(spark, from_turns(talks)).select("tree", read_turns(F.col("formatted")).alias("t")).collect()}
    assert [t.text for t in got[1]] == ["a", "a", ""] and len(got[None]) == 1 and [t.text for t in got[3]] == [str(k) for k in range(70)]


def test_against_sql(spark, data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({OP8_SQL}) ORDER BY ALL").fetchall()
    assert sorted(tuple(r[n] for n in names) for r in op8_format_chats(spark, data).toArrow().to_pylist()) == want


def test_no_python_on_the_way(spark, data):
    from lakemill.llm.chat import op8_format_chats

    plan = op8_format_chats(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
