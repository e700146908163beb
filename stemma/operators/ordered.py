"""Operators over order: as-of joins, interval unions and gaps, blocks, neighbours, layouts, trailing rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.plans.state import placed


def latest_before(probes: DataFrame, facts: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """For each probe (key, order, ...) the value of the key's latest fact strictly before it, or null: one sort, no range
    join. At equal order the probe comes first."""
    columns = [c for c in probes.columns if c not in (key, order)]
    p = probes.select(key, order, F.struct(*columns).alias("_p"), F.lit(None).cast(facts.schema[value].dataType).alias("_v"), F.lit(0).alias("_side"))
    f = facts.select(key, order, F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.col(value).alias("_v"), F.lit(1).alias("_side"))
    w = Window.partitionBy(key).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = p.unionByName(f).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 0").select(key, order, "_p.*", value)


def previous_of_type(units: DataFrame, by: str, pos: str, kind: Column, most: int = 30) -> DataFrame:
    """units with `target`: the nearest earlier position, within `most` rows, of a unit for which kind holds."""
    w = Window.partitionBy(by).orderBy(pos).rowsBetween(-most, -1)
    return units.withColumn("target", F.last(F.when(kind, F.col(pos)), ignorenulls=True).over(w))


def merged_spans(spans: DataFrame, by: str) -> DataFrame:
    """spans(by, start, end) -> maximal spans: overlapping and touching ones join."""
    w = Window.partitionBy(by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    island = spans.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_island")


def gaps(spans: DataFrame, by: str, low: Column, high: Column) -> DataFrame:
    """The parts of [low, high) that no span of merged_spans covers."""
    merged = merged_spans(spans, by)
    w = Window.partitionBy(by).orderBy("start")
    between = merged.select(by, F.coalesce(F.lag("end").over(w), low).alias("start"), F.col("start").alias("end"))
    last = merged.groupBy(by).agg(F.max("end").alias("start")).select(by, "start", high.alias("end"))
    return between.unionByName(last).where(F.col("start") < F.col("end"))


def blocks(units: DataFrame, by: str, pos: str, starts: Column) -> DataFrame:
    """units with `block`: a unit for which `starts` holds opens one, every other continues; the first is 1."""
    w = Window.partitionBy(by).orderBy(pos)
    opens = F.when(starts | (F.row_number().over(w) == 1), 1).otherwise(0)
    return units.withColumn("_open", opens).withColumn("block", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_open")


def neighbours(units: DataFrame, by: str, pos: str, text: Column, n: int) -> DataFrame:
    """units with `before` and `after`: the texts of up to n units on either side, in order."""
    w = Window.partitionBy(by).orderBy(pos)
    return units.withColumns({"before": F.collect_list(text).over(w.rowsBetween(-n, -1)), "after": F.collect_list(text).over(w.rowsBetween(1, n))})


def _within(nodes: DataFrame, kind: str) -> DataFrame:
    """nodes(id, kind, pos) with `_i`, the place within the kind in document order, and `_n`, the kind's size: places of
    all rows less the first of the kind, so that a kind of any size is spread over many tasks."""
    rows = placed(nodes, "_i", F.col(kind), F.col("pos"), F.col("id"))
    first = rows.groupBy(kind).agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    known = F.col(f"r.{kind}").eqNullSafe(F.col(f"f.{kind}"))
    return rows.alias("r").join(first.alias("f"), known).select("r.*", (F.col("r._i") - F.col("f._first")).alias("_place"), "f._n", "f._first").drop("_i").withColumnRenamed("_place", "_i")


def swimlanes(nodes: DataFrame, column: int = 230, row: int = 95) -> DataFrame:
    """nodes(id, kind, pos) with x and y: a lane per kind in order of its name, a row per node in document order."""
    lanes = placed(nodes.select("kind").distinct(), "_lane", F.col("kind"))
    rows = _within(nodes, "kind").alias("r").join(lanes.alias("l"), F.col("r.kind").eqNullSafe(F.col("l.kind"))).select("r.*", "l._lane")
    return rows.withColumns({"x": (F.col("_lane") * column).cast("int"), "y": (F.col("_i") * row).cast("int")}).drop("_i", "_n", "_first", "_lane")


def serpentine(nodes: DataFrame, column: int = 230, row: int = 160) -> DataFrame:
    """nodes(id, pos) on a grid in document order, every second row reversed; columns: max(4, round(sqrt(1.7 n)))."""
    n = nodes.agg(F.greatest(F.lit(4), F.floor(F.sqrt(1.7 * F.count("*")) + 0.5)).cast("int").alias("_cols"))
    at = placed(nodes, "_i", F.col("pos"), F.col("id")).crossJoin(F.broadcast(n))
    line = F.floor(F.col("_i") / F.col("_cols")).cast("int")
    inside = (F.col("_i") % F.col("_cols")).cast("int")
    return at.withColumns({"x": F.when(line % 2 == 1, F.col("_cols") - 1 - inside).otherwise(inside) * column, "y": line * row}).drop("_i", "_cols")


def layered(nodes: DataFrame, level: int = 165, gap: int = 215) -> DataFrame:
    """nodes(id, depth, pos) with x and y: a level per depth, its nodes in document order around 0."""
    rows = _within(nodes, "depth")
    return rows.withColumns({"x": (F.col("_i") - (F.col("_n") - 1) / 2) * gap, "y": F.col("depth") * level}).drop("_i", "_n", "_first")


def trailing(events: DataFrame, by: str, ts: str, seconds: int, value: Column, bucket: int = 60) -> DataFrame:
    """events with `n` and `total` over the seconds up to and with each event.

    Time is cut into buckets of `bucket` times the seconds; an event of a bucket's last seconds also goes to the next one
    as context, so a busy group is spread over its buckets.
    """
    width, reach = bucket * seconds * 1_000_000, seconds * 1_000_000
    at = F.unix_micros(ts)
    own = F.floor(at / width)
    late = F.pmod(at, F.lit(width)) >= width - reach
    copies = F.when(late, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = events.select("*", value.alias("_value"), at.alias("_at"), F.explode(copies).alias("_copy")).withColumn("_bucket", own + F.col("_copy"))
    w = Window.partitionBy(by, "_bucket").orderBy("_at").rangeBetween(-reach, 0)
    out = rows.withColumns({"n": F.count("*").over(w), "total": F.sum("_value").over(w)}).where("_copy = 0")
    return out.drop("_value", "_at", "_copy", "_bucket")
