"""Reply trees to formatted conversations with a loss mask.

Self-joins that double their reach list every root-to-leaf path, branches of
one root are ranked by score, and each chosen path becomes one text in which
``<|im_start|>role`` and ``<|im_end|>`` mark the turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageflow.sources.shared import staged

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""Make control strings harmless: ``\`` becomes ``\\``, then ``<|`` becomes ``<\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    r"""As ``escape``; a role also ends its line, so a line feed becomes ``\N``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\N"))


def unescape(text: Column) -> Column:
    r"""Undo ``escape`` and ``escape_role``: ``\\`` pairs first, so that none is read twice."""
    parts = F.split(text, r"\\\\")
    plain = F.transform(
        parts, lambda x: F.replace(F.replace(x, F.lit("\\|"), F.lit("|")), F.lit("\\N"), F.lit("\n"))
    )
    return F.array_join(plain, "\\")


def reply_paths(messages: DataFrame) -> DataFrame:
    """Rows (leaf, node_id, depth) for all paths of rows (node_id, parent_id).

    Node ids are unique and not null.  A message whose parent is null or
    unknown is a root.  The reach of the known ancestors doubles with each pair
    of joins, so a path of n messages takes about log2(n) of them.  Messages on
    a cycle, and replies below one, have no root and belong to no path; all
    others keep theirs.
    """
    nodes = messages.select("node_id", "parent_id")
    known = nodes.select(F.col("node_id").alias("parent_id"))
    jump = staged(
        nodes.join(known, "parent_id", "left_semi").select(F.col("node_id").alias("at"), F.col("parent_id").alias("up")),
        "parents",
    )
    leaves = nodes.join(jump.select(F.col("up").alias("node_id")), "node_id", "left_anti")
    paths = leaves.select(F.col("node_id").alias("leaf"), "node_id", F.lit(0).cast("long").alias("height"))
    reach, before = 1, None
    while (n := jump.count()) > 0:
        if n == before:
            # a tree this deep has messages of every smaller depth, and those drop out in each round:
            # where none did, all that are left climb a cycle
            paths = paths.join(jump.select(F.col("at").alias("leaf")), "leaf", "left_anti")
            break
        higher = paths.join(jump, F.col("node_id") == F.col("at")).select(
            "leaf", F.col("up").alias("node_id"), (F.col("height") + reach).alias("height")
        )
        paths = staged(paths.unionByName(higher), "paths")
        onward = jump.select(F.col("at").alias("up"), F.col("up").alias("top"))
        jump = staged(jump.join(onward, "up").select("at", F.col("top").alias("up")), "ancestors")
        reach, before = 2 * reach, n
    depth = F.max("height").over(Window.partitionBy("leaf")) - F.col("height")
    return paths.select("leaf", "node_id", depth.alias("depth"))


def format_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """One row (root_id, leaf_id, branch, n_turns, text, loss_spans) for each chosen path.

    ``messages``: node_id, parent_id, role, text, score.  Branches of a root
    go by the sum of their scores, highest first, then by leaf; ``branches``
    keeps the first so many.  Null texts, roles and scores are empty or 0.
    ``loss_spans``: start (from 0) and length, in code points, of each
    assistant's escaped text within ``text``.  No message, no row.
    """
    body = escape(F.coalesce(F.col("text"), F.lit("")))
    head = F.concat(F.lit(START), escape_role(F.coalesce(F.col("role"), F.lit(""))), F.lit("\n"))
    turns = messages.select(
        "node_id",
        F.coalesce(F.col("score"), F.lit(0.0)).alias("score"),
        F.concat(head, body, F.lit(END + "\n")).alias("piece"),
        F.length(head).alias("skip"),
        F.length(body).alias("chars"),
        (F.col("role").eqNullSafe("assistant")).alias("learned"),
    )
    on_path = Window.partitionBy("leaf").orderBy("depth")
    placed = (
        reply_paths(messages)
        .join(turns, "node_id")
        .withColumn("start", F.sum(F.length("piece")).over(on_path) - F.length("piece") + F.col("skip"))
    )
    span = F.when(
        F.col("learned"),
        F.struct(F.col("start").cast("long").alias("start"), F.col("chars").cast("long").alias("length")),
    )
    turn = F.struct("depth", "piece", span.alias("span"), "node_id")
    paths = (
        placed.groupBy("leaf")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.sum("score").alias("score"))
        .select(
            F.col("turns")[0]["node_id"].alias("root_id"),
            F.col("leaf").alias("leaf_id"),
            "score",
            F.size("turns").cast("long").alias("n_turns"),
            F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("text"),
            F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        )
    )
    ranked = paths.withColumn(
        "branch", F.row_number().over(Window.partitionBy("root_id").orderBy(F.col("score").desc(), "leaf_id"))
    ).drop("score")
    return ranked if branches is None else ranked.where(F.col("branch") <= branches)


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped."""
    pieces = F.split(text, r"<\|im_start\|>")
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        rest = F.substr(piece, F.length(role) + 2)
        return F.struct(
            unescape(role).alias("role"), unescape(F.substring_index(rest, END, 1)).alias("text")
        )

    return F.transform(pieces, turn)


def read_loss(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(text, s["start"] + 1, s["length"]))), ""
    )


def conversation_messages(rows: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees.

    Each row replies to the one before it by turn (null first), then role and
    text; a null conv_id is a conversation of its own.
    """
    in_order = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    number = F.row_number().over(in_order)
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn("no", number)
    return numbered.select(
        "conv_id",
        F.concat_ws(":", name, F.col("no").cast("string")).alias("node_id"),
        F.when(F.col("no") > 1, F.concat_ws(":", name, (F.col("no") - 1).cast("string"))).alias("parent_id"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def formatted_conversations(rows: DataFrame) -> DataFrame:
    """Format linear conversations; rows (conv_id, n_turns, text, loss_spans)."""
    paths = format_paths(conversation_messages(rows))
    name = F.substring_index("root_id", ":", 1)
    return paths.select(
        F.when(name != "null", name.cast("long")).alias("conv_id"), "n_turns", "text", "loss_spans"
    )
