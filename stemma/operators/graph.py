"""Dependency graph: degrees, salience, depth, neighbourhoods, components, merging and filtering of edges.

Edges are (src, dst, ...), from the dependent node to its support. Iterative operators write their state each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.operators.evidence import negates
from stemma.plans.state import placed, written

# The relations of edges, and how a reason begins that a reference gave.
LOGIC, DEFINITION, BY_REFERENCE = "逻辑依赖", "定义依赖", "正则匹配："

# The weight of a node type in salience.
TYPE_WEIGHTS = {"定理": 1.0, "公理": 0.95, "定义": 0.9, "引理": 0.78, "命题": 0.72, "推论": 0.66, "性质": 0.6, "例子": 0.42}
# The first pattern found in an edge's label and description names its kind.
EDGE_KINDS = (
    ("特例|特殊情形|特化|是.*的特例|special case", "specializes"),
    ("推广|一般化|generaliz", "generalizes"),
    ("等价|充要|iff|equivalent", "equivalent"),
    ("反例|矛盾|否定|contradict|counterexample", "contradicts"),
    ("举例|例证|示例|exemplif|instance of", "exemplifies"),
    ("引用定义|定义引用|套用定义|uses? definition|based on (the )?definition", "defines"),
    ("推导|推出|证明|导出|蕴含|derive|imply|prove", "derives"),
    ("依赖|前置|先于|prerequisite|depend|需要|基于|建立在", "derives"),
    ("使用|应用|利用|借助|调用|apply|use", "uses"),
)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(id), edges(src, dst) -> id, degree: in and out, over known ids; a self-loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def salience(nodes: DataFrame, edges: DataFrame, weights: dict[str, float] = TYPE_WEIGHTS) -> DataFrame:
    """nodes(id, node_type, label) -> id, degree, salience: type weight, logarithmic degree and a bonus for a number."""
    found = nodes.join(degrees(nodes, edges), "id")
    most = found.agg(F.greatest(F.lit(1), F.coalesce(F.max("degree"), F.lit(1))).alias("most"))
    weight = F.lit(0.5)
    for name, w in weights.items():
        weight = F.when(F.col("node_type") == name, w).otherwise(weight)
    numbered = F.when(F.coalesce("label", F.lit("")).rlike("[0-9]"), 0.15).otherwise(0.0)
    value = 0.5 * weight + 0.5 * F.log1p("degree") / F.log1p("most") + numbered
    return found.crossJoin(F.broadcast(most)).select("id", "degree", value.alias("salience"))


def major_nodes(ranked: DataFrame, density: float) -> DataFrame:
    """ranked(id, salience): the top share by salience, at least one, ties by id; density is held within 0.05 and 1."""
    share = min(1.0, max(0.05, density))
    n = ranked.agg(F.greatest(F.lit(1), F.ceil(F.count("*") * share)).alias("_n"))
    return placed(ranked, "place", F.desc("salience"), F.col("id")).withColumn("place", (F.col("place") + 1).cast("int")).crossJoin(F.broadcast(n)).where("place <= _n").drop("_n")


def _anchored(links: DataFrame) -> DataFrame:
    """links(id, up, dist), one for each id, up null at a source -> the same with up the first above that is no id of links, null where
    a source is reached, and the sum of dist, by pointer doubling. Ids that go round in a circle, or lead into one, are left out."""
    ids = links.select("id")
    done = F.col("up").isNull() | F.col("end")
    marked = lambda df: df.join(ids.select(F.col("id").alias("up"), F.lit(True).alias("known")), "up", "left").select("id", "up", "dist", F.col("known").isNull().alias("end"))
    all_ = written(marked(links), "anchored")
    open_, most = all_.where(~done).count(), all_.count()
    span = 1
    while open_ and span <= most:
        to = all_.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("dist").alias("_dist"), F.col("end").alias("_end"))
        far = all_.where(~done).join(to, "up").select("id", F.col("_up").alias("up"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_end").alias("end"))
        all_, span = written(all_.where(done).unionByName(far), "anchored"), span * 2
        open_ = all_.where(~done).count()
    return all_.where(done).select("id", "up", "dist")


def longest_depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(id), edges(src, dst) -> id, depth, cyclic: the longest path from nodes without an incoming edge.

    Nodes on a cycle, and those behind one, get the largest depth plus one and cyclic = true (the browser's loop would
    never end there). A node with one open predecessor lies a fixed way behind it, so chains and trees of such nodes shrink
    onto where they begin at once, by pointer doubling: a round for each doubling of their length. All that is settled
    counts as one source from which the longest edge stays; what then has one predecessor shrinks next. So chains take one
    round, and other graphs at most one for each node on a path where several ways of different starts meet.
    """
    ids = written(nodes.select("id").distinct(), "ids")
    edges = edges.select("src", "dst").where("src <> dst").distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    edges = written(edges, "edges")
    behind = edges.select(F.col("dst").alias("src"), F.lit(True).alias("_open")).distinct()
    # a null src is all that is settled; w is the depth that it gives, or the way from src
    left = written(edges.join(behind, "src", "left").select(F.when(F.col("_open"), F.col("src")).alias("src"), "dst", F.lit(1).cast("long").alias("w")).groupBy("dst", "src").agg(F.max("w").alias("w")), "left")
    rounds = []
    while True:
        lone = written(left.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.max("src").alias("up"), F.max("w").alias("dist")).where("n = 1").drop("n"), "lone")
        if not lone.limit(1).count():
            break
        shrunk = written(_anchored(lone), "shrunk")
        rounds.append(shrunk)
        rest = left.join(lone.select(F.col("id").alias("dst")), "dst", "left_anti")
        to = shrunk.select(F.col("id").alias("src"), F.col("up").alias("_up"), F.col("dist").alias("_dist"), F.lit(True).alias("_moved"))
        moved = rest.join(to, "src", "left").select(F.when(F.col("_moved"), F.col("_up")).otherwise(F.col("src")).alias("src"), "dst", (F.col("w") + F.coalesce("_dist", F.lit(0))).alias("w"))
        left = written(moved.groupBy("dst", "src").agg(F.max("w").alias("w")), "left")
    every = ids.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").select("id", F.lit(0).cast("long").alias("depth"))
    for shrunk in reversed(rounds):
        at = every.select(F.col("id").alias("up"), F.col("depth").alias("_at"))
        now = shrunk.join(at, "up", "left").where("up is null or _at is not null").select("id", (F.coalesce("_at", F.lit(0)) + F.col("dist")).alias("depth"))
        every = written(every.unionByName(now), "depths")
    every = every.select("id", F.col("depth").cast("int").alias("depth"))
    top = every.agg(F.coalesce(F.max("depth"), F.lit(-1)).alias("top"))
    rest = ids.join(every, "id", "left_anti").crossJoin(F.broadcast(top)).select("id", (F.col("top") + 1).alias("depth"), F.lit(True).alias("cyclic"))
    return every.withColumn("cyclic", F.lit(False)).unionByName(rest)


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """edges(src, dst), start(id) -> id, hop: nodes within so many undirected steps, with the least number of steps."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = start.select("id", F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        step = seen.where(F.col("hop") == hop - 1).join(both, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.lit(hop).alias("hop"))
        seen = seen.unionByName(step).groupBy("id").agg(F.min("hop").alias("hop"))
    return seen


def incident(edges: DataFrame, node: Column) -> DataFrame:
    """Edges of one node with their direction, seen from it."""
    out = edges.where(F.col("src") == node).withColumn("direction", F.lit("out"))
    return out.unionByName(edges.where(F.col("dst") == node).withColumn("direction", F.lit("in")))


def components(pairs: DataFrame, least: int = 2) -> DataFrame:
    """pairs(x, y) -> id, component (least id), size: connected components of at least so many members."""
    both = written(pairs.select("x", "y").unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = written(both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("near")).select("id", F.least("id", "near").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = step.join(labels.select(F.col("id").alias("component"), F.col("component").alias("far")), "component")
        now = written(jump.select("id", "was", F.least("component", "far").alias("component")), "labels")
        labels = now.select("id", "component")
        if not now.where("was <> component").limit(1).count():
            break
    sizes = labels.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return labels.join(sizes, "component").select("id", "component", "size")


def edge_kind(label: Column, description: Column) -> Column:
    """The kind of an edge: that of the first pattern found in label and description, else related."""
    text = F.concat_ws(" ", F.coalesce(label, F.lit("")), F.coalesce(description, F.lit("")))
    out = F.lit("related")
    for pattern, kind in reversed(EDGE_KINDS):
        out = F.when(text.rlike(f"(?iu){pattern}"), kind).otherwise(out)
    return out


def merge_edges(edges: DataFrame) -> DataFrame:
    """edges(src, dst, relation, reason, pos) -> one per (src, dst, relation): reasons in order of pos, each appended
    unless the text so far contains it."""
    listed = edges.groupBy("src", "dst", "relation").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "reason"))).alias("all"))
    joined = F.aggregate("all", F.lit(""), lambda a, r: F.when(F.coalesce(r["reason"], F.lit("")) == "", a).when(a == "", r["reason"]).when(F.contains(a, r["reason"]), a).otherwise(F.concat(a, F.lit("; "), r["reason"])))
    return listed.select("src", "dst", "relation", joined.alias("reason"), "pos")


def upsert_relations(nodes: DataFrame, edges: DataFrame, rows: DataFrame) -> DataFrame:
    """edges(src, dst, label) with those of rows(src, dst, label) that it lacks and both whose ends are in nodes(id)."""
    key, ids = ["src", "dst", "label"], nodes.select("id").distinct()
    held = rows.select(key).distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return edges.unionByName(held.select(key).join(edges, key, "left_anti"), allowMissingColumns=True)


def delete_relations(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges(src, dst, label, ...) without those of gone(src, dst, label)."""
    return edges.join(gone, ["src", "dst", "label"], "left_anti")


def updated(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with the properties that rows has, by keys, where rows has a row; other properties and rows are kept."""
    new = [c for c in rows.columns if c not in keys]
    changes = rows.select(*keys, F.struct(*new).alias("_new"))
    joined = table.join(changes, keys, "left")
    kept = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns]
    return joined.select(*kept, *[F.col(f"_new.{c}").alias(c) for c in new if c not in table.columns])


def edge_priority(relation: Column, reason: Column) -> Column:
    """4 for a reason by reference, 2 for a definition, 1 for logic, and a thousandth for each character of the reason up to 120."""
    told = F.trim(F.coalesce(reason, F.lit("")))
    kind = F.trim(F.coalesce(relation, F.lit("")))
    points = F.when(F.startswith(told, F.lit(BY_REFERENCE)), 4000).otherwise(0) + F.when(kind == DEFINITION, 2000).when(kind == LOGIC, 1000).otherwise(0) + F.least(F.char_length(told), F.lit(120))
    return points / 1000


def filter_edges(edges: DataFrame, order: DataFrame, known: tuple[str, ...] = (LOGIC, DEFINITION)) -> DataFrame:
    """edges(src, dst, relation, reason, pos), order(id, pos) -> the edges that stay, trimmed, with priority.

    Known relations between two different nodes stay, unless the reason denies them. Of edges of one ordered pair the one of
    most priority stays (the first by pos among equals); of two opposite ones again, among equals the one whose start
    stands later in order (nodes that order lacks stand before all), and if both starts stand alike, that of the pair
    which comes first.
    """
    text = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("src", "dst", "relation", "reason")}
    good = edges.select(*[t.alias(c) for c, t in text.items()], "pos").where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")) & F.col("relation").isin(*known) & ~negates(F.col("reason")))
    rank = F.struct("priority", (-F.col("pos")).alias("p"))
    best = good.withColumn("priority", edge_priority(F.col("relation"), F.col("reason"))).groupBy("src", "dst").agg(F.max_by(F.struct("relation", "reason", "priority", "pos"), rank).alias("e"), F.min("pos").alias("first"))
    places = order.select(F.trim(F.col("id").cast("string")).alias("id"), F.col("pos").alias("place")).groupBy("id").agg(F.max("place").alias("place"))
    best = best.select("src", "dst", "e.*", "first").join(places.toDF("src", "_from"), "src", "left").join(places.toDF("dst", "_to"), "dst", "left")
    later = F.coalesce("_from", F.lit(-1)) - F.coalesce("_to", F.lit(-1))
    best = best.select("src", "dst", "relation", "reason", "priority", "pos", "first", later.alias("later"))
    back = best.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.struct("priority", "later", (-F.col("first")).alias("first")).alias("back"))
    stays = F.col("back").isNull() | (F.struct("priority", "later", (-F.col("first")).alias("first")) > F.col("back"))
    return best.join(back, ["src", "dst"], "left").where(stays).select("src", "dst", "relation", "reason", "priority", "pos")


def leaders(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes(id), links(x, y) between alike ones -> (id, leader): taken in order of id, each node that no leader has claimed leads,
    and claims all alike; a node is claimed by its least leader.

    Rounds: a node leads when every lesser one alike is claimed, and is claimed when one of them leads; so the least
    undecided of any chain is decided in each round, and of links in no order some logarithm of the nodes suffices, while
    a chain of ascending ids takes a round for each second node. Links of decided nodes drop out.
    """
    down = links.select(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")).where("low < high").distinct()
    down = written(down.join(nodes.select(F.col("id").alias("low")), "low", "left_semi").join(nodes.select(F.col("id").alias("high")), "high", "left_semi"), "down")
    alone = nodes.select("id").distinct().join(down.select(F.col("high").alias("id")).distinct(), "id", "left_anti")
    done, left = [alone.select("id", F.col("id").alias("leader"))], down
    leading = written(alone, "leading")
    while True:
        # claimed: those alike to a new leader; of several, links of earlier rounds have claimed already, so the least of now
        claimed = written(left.join(leading.withColumnRenamed("id", "low"), "low").groupBy(F.col("high").alias("id")).agg(F.min("low").alias("leader")), "claimed")
        done.append(claimed)
        gone = claimed.select("id").unionByName(leading)
        rest = left.join(gone.withColumnRenamed("id", "high"), "high", "left_anti")
        open_ids = rest.select(F.col("high").alias("id")).distinct()
        left = written(rest.join(gone.withColumnRenamed("id", "low"), "low", "left_anti"), "left")
        # open nodes without a lesser open one alike lead now
        leading = written(open_ids.join(left.select(F.col("high").alias("id")).distinct(), "id", "left_anti"), "leading")
        if not leading.limit(1).count():
            break
        done.append(leading.select("id", F.col("id").alias("leader")))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    claims = down.withColumnRenamed("high", "id").join(every.where("id = leader").select(F.col("id").alias("low")), "low").groupBy("id").agg(F.min("low").alias("claim"))
    return every.join(claims, "id", "left").select("id", F.coalesce("claim", "leader").alias("leader"))


def collapse_titles(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(id, title), edges(src, dst, label): nodes of equal lower-cased title become the first; edges follow, and
    self-loops and repeated (src, dst, label) go."""
    first = nodes.withColumn("canonical", F.min("id").over(Window.partitionBy(F.lower("title"))))
    to = first.select("id", "canonical")
    a, b = to.toDF("src", "s"), to.toDF("dst", "d")
    moved = edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "label")
    return first.where("id = canonical").select("id", "title"), moved.where("src <> dst").distinct()


def match_relations(nodes: DataFrame, edges: DataFrame, label: str | None = None) -> DataFrame:
    """(a)-[r]->(b): each edge with both its nodes (id, name); edges without an end in nodes don't match."""
    e = edges if label is None else edges.where(F.col("label") == label)
    a = nodes.select(F.col("id").alias("src"), F.col("name").alias("src_name"))
    b = nodes.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    return e.join(a, "src").join(b, "dst")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows added or, where the keys exist, replaced (single writer: write the result over the table)."""
    return table.join(rows, keys, "left_anti").unionByName(rows)


def merge_nodes(table: DataFrame, rows: DataFrame) -> DataFrame:
    """table and those rows that aren't in it, all columns compared, null equal to null."""
    return table.unionByName(rows.exceptAll(table.intersect(rows)).distinct().subtract(table))


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without the nodes of gone(id) and without every edge that touches one."""
    g = gone.select("id").distinct()
    kept = edges.join(g.withColumnRenamed("id", "src"), "src", "left_anti").join(g.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(g, "id", "left_anti"), kept.select(edges.columns)


def with_value(nodes: DataFrame, key: str, value, label: str | None = None) -> DataFrame:
    """Nodes whose property has the value, of one label if given."""
    rows = nodes if label is None else nodes.where(F.col("label") == label)
    return rows.where(F.col(key) == F.lit(value))


def distinct_in_order(nodes: DataFrame, key: str) -> DataFrame:
    """(value, place): the distinct values of a property in order, null last."""
    return placed(nodes.select(F.col(key).alias("value")).distinct(), "place", F.col("value").asc_nulls_last())


def title_view(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(id, title), edges(src_title, dst_title, label): nodes under their title, the second of equal ones with #2 and
    so on; an edge between titles becomes one between each pair of their holders, as the view intends."""
    place = F.row_number().over(Window.partitionBy("title").orderBy("id"))
    named = nodes.where("title is not null").withColumn("unique_id", F.concat("title", F.when(place > 1, F.concat(F.lit("#"), place.cast("string"))).otherwise(F.lit(""))))
    a, b = named.select(F.col("title").alias("src_title"), F.col("unique_id").alias("src")), named.select(F.col("title").alias("dst_title"), F.col("unique_id").alias("dst"))
    return named, edges.join(a, "src_title").join(b, "dst_title").select("src", "dst", "label")
