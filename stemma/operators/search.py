"""Search down a tree, a frontier of all statements at once, pruned by answers from a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.plans.state import written

#: The kind of a tree's node that can be an end worth keeping.
LEAF = "lean"


def tree_search(tree: DataFrame, statements: DataFrame, answers: DataFrame) -> DataFrame:
    """tree(id, parent, name, level, type), statements(statement), answers(statement, node, name) -> the ends of the search:
    statement, node, level, path, state.

    Every statement starts at the root (null parent, level 0; the least id if several). A node without children, or without
    an answer, is an end: active if its type is LEAF, else dead. An answer names nodes one level below: the least id of that
    name on that level wherever it hangs, so ids should follow reading order; names that aren't there lead nowhere, and a
    node with only such answers is an end whose state is null. A repeated answer is followed twice. Answers of null name or
    of nodes without children are ignored; an empty tree has no ends. Names are resolved once, for all answers; then a
    round, written, takes the whole frontier one level down by a single join, so there are as many as the tree has levels."""
    nodes = tree.select("id", "parent", "name", F.col("level").cast("int").alias("level"), "type")
    root = nodes.where(F.col("parent").isNull()).orderBy("id").first()
    targets = nodes.groupBy("name", "level").agg(F.min(F.struct("id", "type")).alias("t")).select("name", F.col("level").alias("below"), F.col("t.id").alias("child"), F.col("t.type").alias("child_type"))
    inner = nodes.join(nodes.select(F.col("parent").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("node"), (F.col("level") + 1).alias("below"))
    asked = answers.select("statement", "node", "name").where(F.col("name").isNotNull()).join(inner, "node").join(targets, ["name", "below"], "left")
    each = Window.partitionBy("statement", "node")
    led, place = F.max(F.col("child").isNotNull()).over(each), F.row_number().over(each.orderBy("name"))
    asked = asked.select("statement", "node", F.col("name").alias("step"), "child", "child_type", led.alias("led"), place.alias("place"))
    # a node that its answers lead nowhere keeps one row: it is one end
    step = written(asked.where("child IS NOT NULL OR NOT led AND place = 1").drop("place"), "answers")

    ids = nodes.schema["id"].dataType
    start = [F.lit(x) for x in (root.id, root.level, root.type)] if root else [F.lit(None)] * 3
    frontier = statements.select("statement", start[0].cast(ids).alias("node"), start[1].cast("int").alias("level"), F.lit("").alias("path"), start[2].cast("string").alias("type"))
    rounds = []
    while root:
        went = written(frontier.join(step, ["statement", "node"], "left"), "frontier")
        rounds.append(went)
        frontier = went.where(F.col("child").isNotNull()).select(
            "statement", F.col("child").alias("node"), (F.col("level") + 1).alias("level"), F.concat_ws("/", F.nullif("path", F.lit("")), "step").alias("path"), F.col("child_type").alias("type")
        )
        if frontier.isEmpty():
            break
    if not rounds:
        return frontier.where("false").select("statement", "node", "level", "path", F.lit(None).cast("string").alias("state"))
    ended = reduce(DataFrame.unionByName, (w.where("led IS NULL OR NOT led") for w in rounds))
    state = F.when(F.col("led").isNotNull(), None).when(F.col("type") == LEAF, "active").otherwise("dead")
    return ended.select("statement", "node", "level", "path", state.alias("state"))
