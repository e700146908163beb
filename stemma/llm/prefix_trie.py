"""Trie of the conversations' prefixes, with sums over subtrees by heavy-path decomposition.

A node is a distinct sequence of first turns. Its key is its depth and a 128-bit sum of hashes of its turns, each hashed
with its place; sums of parts of a conversation add up, so that a long conversation is dealt over many tasks.

Sums over subtrees: each node's heavy child is the one with most members (ties: the least conv_id). A light child has at
most half of its parent's members, so a way up to the root crosses at most log2(conversations) light links. Nodes find
the head of their heavy path by pointer doubling, each path's sum is attached to the parent of its head, path by path
upwards in as many rounds, and at last each path is summed from its end.
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import heavy_join, hot_keys, only, ranked, written

#: Places of a conversation, or of a heavy path, that one window adds up; the parts' totals are added up apart.
PART = 1000
#: Conversations of one range of ids, whose ids are joined to one text.
IDS = 1 << 16
LOW = (1 << 32) - 1
WORD = "[^\\x20\\x09-\\x0D]+"


def numbered(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> (conv_id, pos, length, digest, n_words), written: pos from 0 in the order of
    turn, null first; turns that share a number stand in the order of their digests. length: the conversation's turns.

    A null role or text counts as empty, rows of a null conv_id belong to no conversation. Only digests are shuffled,
    however long a text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = only(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", said.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"))
    placed = ranked(rows, [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("digest")], "place")
    first = written(placed.groupBy("conv_id").agg(F.min("place").alias("first"), F.count("*").alias("length")), "conversations")
    hot = hot_keys(first.select("conv_id", F.col("length").alias("n")), "conv_id")
    joined = heavy_join(placed, first, "conv_id", "place", hot)
    return written(joined.select("conv_id", (F.col("place") - F.col("first")).alias("pos"), "length", "digest", "n_words"), "turns")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: numbered turns -> (turns, conversations(conv_id, length)) of the rebuilt ones.

    Conversation c begins with the first h turns of c - c % every (all if that has fewer, none if it is absent), followed
    by its own turns after its first h; h = crc32(c in decimal) % most. What is left may have no turn.
    """
    first = turns.where("pos = 0").select("conv_id", "length")
    base = F.col("conv_id") - F.col("conv_id") % every
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    lengths = first.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length")).where(f"base % {every} = 0")
    plan = first.select("conv_id", base.alias("base"), h.alias("h"), F.col("length").alias("own")).join(lengths, "base", "left")
    shared = F.least("h", F.coalesce("base_length", F.lit(0)))
    plan = written(plan.select("conv_id", "base", "h", "own", shared.alias("shared"), (shared + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("new_length")), "plan")
    heads = turns.where(f"conv_id % {every} = 0 and pos < {most}").select(F.col("conv_id").alias("base"), "pos", "digest", "n_words")
    before = plan.join(heads, "base").where("pos < shared").select("conv_id", "pos", F.col("new_length").alias("length"), "digest", "n_words")
    hot = hot_keys(plan.select("conv_id", F.col("own").alias("n")), "conv_id")
    after = heavy_join(turns.drop("length"), plan.select("conv_id", "h", "shared", "new_length"), "conv_id", "pos", hot).where("pos >= h")
    after = after.select("conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), F.col("new_length").alias("length"), "digest", "n_words")
    return before.unionByName(after), plan.select("conv_id", F.col("new_length").alias("length"))


def _running(rows: DataFrame, key: list[str], place: str, names: list[str], up: bool = True) -> DataFrame:
    """rows with the running sums of the named columns in the order of place (downwards with up=False), by key, in parts of PART places."""
    order = lambda c: F.asc(c) if up else F.desc(c)
    rows = rows.withColumn("_part", F.floor(F.col(place) / PART))
    within = Window.partitionBy(*key, "_part").orderBy(order(place)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy(order("_part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*key, "_part").agg(*[F.sum(n).alias(n) for n in names])
    bases = totals.select(*key, "_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in names])
    sums = rows.withColumns({n: F.sum(n).over(within) for n in names}).join(bases, [*key, "_part"])
    return sums.withColumns({n: F.col(n) + F.col(f"_{n}") for n in names}).drop("_part", *[f"_{n}" for n in names])


def _prefixes(turns: DataFrame) -> DataFrame:
    """turns -> a row for each conversation and depth: node and up, the keys of the prefix and of the one before."""

    def half(seed: int, shift: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "pos", "digest"), shift).bitwiseAND(F.lit(LOW))

    own = {"k0": half(1, 0), "k1": half(1, 32), "k2": half(2, 0), "k3": half(2, 32)}
    sums = _running(turns.withColumns(own | {f"o{i}": c for i, c in enumerate(own.values())}), ["conv_id"], "pos", list(own))

    def key(depth: Column, parts: list[Column]) -> Column:
        low = [p.bitwiseAND(F.lit(LOW)) for p in parts]
        return F.struct(depth.cast("long").alias("depth"), F.shiftleft(low[0], 32).bitwiseOR(low[1]).alias("a"), F.shiftleft(low[2], 32).bitwiseOR(low[3]).alias("b"))

    here = key(F.col("pos") + 1, [F.col(k) for k in own])
    up = key(F.col("pos"), [F.col(k) - F.col(f"o{i}") for i, k in enumerate(own)])
    return sums.select("conv_id", here.alias("node"), up.alias("up"), "n_words", (F.col("pos") + 1 == F.col("length")).alias("last"))


def _hashed(batches):
    """Rows (depth, a, b, ids), sorted -> the SHA-256 of each node's joined ids, text after text."""
    at, state = None, None
    for batch in batches:
        done = []
        for *node, ids in batch[["depth", "a", "b", "ids"]].itertuples(index=False):
            if node != at:
                if at:
                    done.append((*at, state.hexdigest()))
                at, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["depth", "a", "b", "ends_sha256"])
    if at:
        yield pd.DataFrame([(*at, state.hexdigest())], columns=["depth", "a", "b", "ends_sha256"])


def _ends(ended: DataFrame) -> DataFrame:
    """ended(node, conv_id) -> node, ends_sha256. Ids are joined by ranges of IDS, a node's ranges hashed one after the other, so no list is held whole."""
    parts = ended.groupBy("node", F.floor(F.col("conv_id") / IDS).alias("range")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    flat = parts.select("node.depth", "node.a", "node.b", "range", "ids").repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "range")
    got = flat.mapInPandas(_hashed, "depth long, a long, b long, ends_sha256 string")
    return got.select(F.struct("depth", "a", "b").alias("node"), "ends_sha256")


def _heads(nodes: DataFrame) -> DataFrame:
    """nodes with the head of each one's heavy path (head_conv, head_depth) and that head's parent (head_up), by pointer doubling.

    Only nodes whose pointer isn't at a head yet are joined, and their targets all differ: no key has more than one row.
    """
    at = nodes.select("conv_id", "depth", "n_leaves", "saved_tokens", F.when(F.col("heavy"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("head_conv"),
                      (F.col("depth") - F.col("heavy").cast("long")).alias("head_depth"), F.when(~F.col("heavy"), F.col("parent_conv_id")).alias("head_up"), (~F.col("heavy")).alias("done"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    for _ in range(math.ceil(math.log2(deepest)) + 1 if deepest else 0):
        at = written(at, "heads")
        target = at.select(F.col("conv_id").alias("head_conv"), F.col("depth").alias("head_depth"), F.struct("head_conv", "head_depth", "head_up", "done").alias("to"))
        moved = at.where("not done").join(target, ["head_conv", "head_depth"]).select("conv_id", "depth", "n_leaves", "saved_tokens", "to.*")
        at = at.where("done").unionByName(moved)
    return written(at.drop("done"), "heads")


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """nodes(conv_id, depth, parent_conv_id, heavy, n_leaves, saved_tokens of their own) -> the same two summed over subtrees."""
    names = ["n_leaves", "saved_tokens"]
    sums = [F.sum(n).alias(n) for n in names]
    path = ["head_conv", "head_depth", "head_up"]
    on_path = _heads(nodes)
    paths, attached = on_path.groupBy(*path).agg(*sums), []
    while True:
        light = paths.where("head_depth > 0").groupBy(F.col("head_up").alias("conv_id"), (F.col("head_depth") - 1).alias("depth")).agg(*sums)
        light = written(light, "attached")
        if not light.limit(1).count():
            break
        attached.append(light)
        paths = light.join(on_path.drop(*names), ["conv_id", "depth"]).groupBy(*path).agg(*sums)
    values = on_path
    if attached:
        more = attached[0]
        for x in attached[1:]:
            more = more.unionByName(x)
        more = more.groupBy("conv_id", "depth").agg(*[F.sum(n).alias(f"more_{n}") for n in names])
        values = on_path.join(more, ["conv_id", "depth"], "left").withColumns({n: F.col(n) + F.coalesce(f"more_{n}", F.lit(0)) for n in names})
    return _running(values, ["head_conv", "head_depth"], "depth", names, up=False).select("conv_id", "depth", *names)


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """turns(conv_id, pos, length, digest, n_words), conversations(conv_id, length) -> a row for each node: conv_id (its smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, heavy (whether it
    continues its parent's path).

    conversations lists those without turns too; they are members of the root alone and end there. No conversation, no
    node. Conversations alike share all nodes.
    """
    rows = written(_prefixes(turns), "prefixes")
    root = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    nodes = rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("up").alias("up"), F.max("n_words").alias("n_words"))
    top = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nodes = written(nodes.unionByName(top.withColumns({"node": root, "up": F.lit(None).cast(nodes.schema["up"].dataType), "n_words": F.lit(0).cast("long")})), "nodes")

    ended = rows.where("last").select("node", "conv_id").unionByName(conversations.where("length = 0").select(root.alias("node"), "conv_id"))
    by_parent = nodes.where("up is not null").groupBy("up").agg(F.count("*").alias("n"), F.max(F.struct("n_convs", (-F.col("conv_id")).alias("least"))).alias("largest"))
    children = written(by_parent.select("up", "n", (-F.col("largest.least")).alias("heavy_conv")), "children")
    whole = nodes.join(_ends(ended), "node", "left").join(children.select(F.col("up").alias("node"), F.col("n").alias("n_children")), "node", "left")
    # each node's parent, and whether it is that one's heavy child; a parent with many children is dealt over several tasks
    parents = nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id")).join(children.drop("n"), "up")
    whole = heavy_join(whole, parents, "up", "conv_id", hot_keys(children.select("up", "n"), "up"), "left")
    n_children = F.coalesce("n_children", F.lit(0).cast("long"))
    whole = whole.select("conv_id", F.col("node.depth").alias("depth"), "parent_conv_id", "n_convs", n_children.alias("n_children"),
                         (n_children == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved_tokens"),
                         F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), F.coalesce(F.col("heavy_conv") == F.col("conv_id"), F.lit(False)).alias("heavy"))
    whole = written(whole, "trie")
    kept = whole.drop("n_leaves", "saved_tokens").join(_subtree_sums(whole), ["conv_id", "depth"])
    return kept.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "heavy")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the beginning of another."""
    return prefix_trie(*rebuilt(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet")))).drop("heavy")


OP11_SQL = """
WITH s AS (SELECT conv_id, said, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) - 1 AS i FROM (
         SELECT conv_id, turn, sha256(length(r) || ':' || r || t) AS said, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS words
         FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL))),
     c AS (SELECT conv_id, count(*) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
              lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) % 4 AS h FROM s GROUP BY conv_id),
     k AS (SELECT c.conv_id, c.n, c.h, c.conv_id - c.conv_id % 20 AS base, least(c.h, coalesce(b.n, 0)) AS m FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
     r AS (SELECT k.conv_id, s.i AS p, said, words FROM k JOIN s ON s.conv_id = base AND i < m
           UNION ALL SELECT k.conv_id, m + i - h, said, words FROM k JOIN s ON s.conv_id = k.conv_id WHERE i >= h),
     x AS (SELECT conv_id, 0 AS depth, '' AS key, 0 AS words FROM k
           UNION ALL SELECT conv_id, p + 1, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY p), words FROM r),
     z AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM x),
     nd AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '') AS ends FROM z GROUP BY depth, key),
     ch AS (SELECT substr(key, 1, 64 * (depth - 1)) AS key, count(*) AS n_children FROM nd WHERE depth > 0 GROUP BY 1),
     su AS (SELECT substr(key, 1, 64 * d) AS key, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * words) AS saved
            FROM (SELECT nd.*, n_children, unnest(range(0, depth + 1)) AS d FROM nd LEFT JOIN ch USING (key)) GROUP BY 1)
SELECT nd.conv_id, nd.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, nd.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(nd.ends) AS ends_sha256
FROM nd LEFT JOIN ch USING (key) JOIN su USING (key) LEFT JOIN nd p ON nd.depth > 0 AND p.key = substr(nd.key, 1, 64 * (nd.depth - 1))
"""
