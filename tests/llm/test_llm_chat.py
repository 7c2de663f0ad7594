import random

from pyspark.sql import functions as F

from pageflow.llm import chat

SCHEMA = "node_id string, parent_id string, role string, text string, score double"


def test_escapes_round_trip(spark):
    random.seed(2)
    parts = ["\\", "\\\\", "<|", "|", "<", "N", "\n", "<|im_end|>", "<|im_start|>user", "é", ""]
    texts = ["".join(random.choices(parts, k=random.randint(0, 9))) for _ in range(2000)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    escaped, role = chat.escape(F.col("t")), chat.escape_role(F.col("t"))
    rows = frame.select("t", escaped.alias("e"), role.alias("r"), chat.unescape(escaped).alias("x"), chat.unescape(role).alias("y")).collect()
    assert all(r.t == r.x == r.y and "<|" not in r.e and "\n" not in r.r for r in rows)


def test_branches_are_ranked_and_formatted(spark):
    rows = [
        ("r", None, "system", "root", 0.0),
        ("u", "r", "user", "hi <|im_end|>", 1.0),
        ("a1", "u", "assistant", "low", 0.5),
        ("a2", "u", "assistant", "high \\ <|x", 2.0),
        ("b", "a2", "user", None, None),
        ("lost", "nobody", None, "alone", 0.0),
    ]
    messages = spark.createDataFrame(rows, SCHEMA)
    found = chat.format_paths(messages).select(
        "*", chat.read_turns(F.col("text")).alias("turns"), chat.read_loss(F.col("text"), F.col("loss_spans")).alias("loss")
    )
    by_leaf = {r.leaf_id: r for r in found.collect()}
    assert {k: (r.root_id, r.branch, r.n_turns) for k, r in by_leaf.items()} == {
        "b": ("r", 1, 4), "a1": ("r", 2, 3), "lost": ("lost", 1, 1),
    }
    assert [tuple(t) for t in by_leaf["b"].turns] == [
        ("system", "root"), ("user", "hi <|im_end|>"), ("assistant", "high \\ <|x"), ("user", ""),
    ]
    assert by_leaf["b"].loss == "high \\ <|x" and by_leaf["lost"].loss == ""
    assert {r.leaf_id for r in chat.format_paths(messages, branches=1).collect()} == {"b", "lost"}


def test_long_paths_take_few_rounds(spark):
    rows = [(f"n{k}", f"n{k - 1}" if k else None, "user", str(k), 0.0) for k in range(300)]
    found = chat.format_paths(spark.createDataFrame(rows, SCHEMA)).first()
    assert found.n_turns == 300 and found.root_id == "n0" and found.leaf_id == "n299"


def test_rows_on_a_cycle_go_nowhere_and_all_others_stay(spark):
    rows = [("a", "b", "user", "x", 0.0), ("b", "a", "user", "y", 0.0), ("below", "a", "user", "w", 0.0), ("self", "self", "user", "v", 0.0)]
    rows += [(f"r{k}", f"r{(k + 1) % 5}", "user", "ring", 0.0) for k in range(5)] + [("deep0", "r3", "user", "d", 0.0)]
    rows += [(f"deep{k}", f"deep{k - 1}", "user", "d", 0.0) for k in range(1, 9)]
    tree = [(f"n{k}", f"n{k - 1}" if k else None, "user", str(k), 0.0) for k in range(23)] + [("m", "n4", "user", "m", 0.0), ("c", None, "user", "z", 0.0)]
    for size in (len(tree), 1, 3):
        found = chat.format_paths(spark.createDataFrame(rows + tree[:size], SCHEMA)).collect()
        alone = chat.format_paths(spark.createDataFrame(tree[:size], SCHEMA)).collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, alone)) and found
    assert chat.format_paths(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_odd_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, score string"
    rows = [(1, None, None, None, "x"), (1, 0, "user\nx", "a", "x"), (1, 0, "user\nx", "a", "x"), (None, 3, "assistant", "b" * 30_000, "x")]
    found = {r.conv_id: r for r in chat.formatted_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert found[1].n_turns == 3 and found[None].n_turns == 1
    assert [tuple(s) for s in found[None].loss_spans] == [(len("<|im_start|>assistant\n"), 30_000)]
    assert chat.formatted_conversations(spark.createDataFrame([], schema)).count() == 0
