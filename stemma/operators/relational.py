"""Projections, predicates, integrity checks, histories, queues and task reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.plans.state import placed


def selected_fields(nodes: DataFrame, kinds: list[str], paths: dict[str, str], include_missing: bool = False) -> DataFrame:
    """nodes(id, node_type, json): those of the kinds (none: all) with the values at JSON paths; unless missing ones are
    asked for, nodes without any of them go."""
    rows = nodes.where(F.col("node_type").isin(*kinds)) if kinds else nodes
    out = rows.select("id", "node_type", *[F.get_json_object("json", p).alias(n) for n, p in paths.items()])
    return out if include_missing else out.where(F.coalesce(*[F.col(n) for n in paths]).isNotNull())


def catalogue(nodes: DataFrame) -> DataFrame:
    """nodes(node_type, json) -> node_type, key, n: the top-level keys that occur, with their counts."""
    keys = F.explode(F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>")))
    return nodes.select("node_type", keys.alias("key")).groupBy("node_type", "key").agg(F.count("*").alias("n"))


def order_by_key(df: DataFrame, key: str) -> DataFrame:
    """df with `place` from 0: whole-number keys first, by value, then the others by text."""
    number = F.expr(f"try_cast(`{key}` as bigint)")
    return placed(df, "place", number.isNull(), number, F.col(key))


def history(rows: DataFrame, owner: str, limit: int) -> DataFrame:
    """The owner's undeleted rows (id, owner, created_at, deleted_at, ...), newest first; limit is held within 1 and 200."""
    kept = rows.where((F.col("owner") == owner) & F.col("deleted_at").isNull())
    return kept.orderBy(F.desc("created_at"), F.desc("id")).limit(min(200, max(1, limit)))


def newest_per_owner(rows: DataFrame, limit: int) -> DataFrame:
    """`history` for every owner at once."""
    w = Window.partitionBy("owner").orderBy(F.desc("created_at"), F.desc("id"))
    return rows.where("deleted_at is null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= min(200, max(1, limit)))


def found_text(rows: DataFrame, fields: list[str], query: str, limit: int = 30) -> DataFrame:
    """Rows (id, ...) in which any field contains the query, case aside; the first `limit` by id."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(query.lower()))
    return rows.where(hit).orderBy("id").limit(limit)


def visible(shown: DataFrame, edges: DataFrame) -> DataFrame:
    """edges(src, dst, ...) both of whose ends are in shown(id)."""
    ids = shown.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose key is set and has no parent."""
    keys = parents.select(F.col(parent_key).alias(child_key)).distinct()
    return children.where(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def checked_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges(src, dst, ...) with `problem`: self_loop, missing_source, missing_target or null."""
    ids = nodes.select("id").distinct()
    a, b = ids.select(F.col("id").alias("src"), F.lit(True).alias("_s")), ids.select(F.col("id").alias("dst"), F.lit(True).alias("_d"))
    joined = edges.join(a, "src", "left").join(b, "dst", "left")
    problem = F.when(F.col("_s").isNull(), "missing_source").when(F.col("_d").isNull(), "missing_target").when(F.col("src") == F.col("dst"), "self_loop")
    return joined.select(*edges.columns, problem.alias("problem"))


def first_by_id(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with `copies` and only the first row of each key kept."""
    w = Window.partitionBy(key)
    out = rows.withColumns({"_r": F.row_number().over(w.orderBy(order)), "copies": F.count("*").over(w)})
    return out.where("_r = 1").drop("_r")


def reconciled(referenced: DataFrame, committed: DataFrame, key: str) -> DataFrame:
    """key, state: missing (referenced, not committed) or orphan (committed, not referenced)."""
    r, c = referenced.select(key).distinct(), committed.select(key).distinct()
    missing = r.join(c, key, "left_anti").withColumn("state", F.lit("missing"))
    return missing.unionByName(c.join(r, key, "left_anti").withColumn("state", F.lit("orphan")))


def backoff(attempts: Column) -> Column:
    """Seconds to wait after so many attempts: 30 doubled each time, an hour at most."""
    return F.least(F.lit(3600), 30 * F.pow(F.lit(2), F.least(attempts - 1, F.lit(7)))).cast("int")


def due(queue: DataFrame, now: Column, limit: int) -> DataFrame:
    """queue(id, status, next_attempt_at, lease_expires_at): pending and due, or running with its lease gone; oldest first."""
    ready = (F.col("status") == "pending") & (F.col("next_attempt_at") <= now)
    lost = (F.col("status") == "processing") & (F.col("lease_expires_at") < now)
    return queue.where(ready | lost).orderBy("next_attempt_at", "id").limit(limit)


def status_counts(rows: DataFrame, status: str, domain: list[str]) -> DataFrame:
    """status, n: a row for each status of the domain, absent ones 0."""
    all_of = rows.sparkSession.createDataFrame([(s,) for s in domain], f"{status} string")
    counts = rows.groupBy(status).agg(F.count("*").alias("n"))
    return all_of.join(counts, status, "left").select(status, F.coalesce("n", F.lit(0)).alias("n"))


def last_states(events: DataFrame) -> DataFrame:
    """events(job, token, seq, status) -> job, status: the last event of each job's current attempt (its largest token);
    events of older attempts are stale and dropped, and nothing follows an error."""
    current = events.withColumn("_t", F.max("token").over(Window.partitionBy("job"))).where("token = _t")
    failed = F.min(F.when(F.col("status") == "error", F.col("seq"))).over(Window.partitionBy("job"))
    kept = current.withColumn("_f", failed).where("_f is null or seq <= _f")
    return kept.groupBy("job").agg(F.max_by("status", "seq").alias("status"), F.count("*").alias("n"))


def failure_report(expected: DataFrame, results: DataFrame, key: str, most: float = 0.05) -> DataFrame:
    """One row: expected, failed, ratio and whether a stage may go on degraded (some but few failures)."""
    ok = results.where("ok").select(key).distinct().withColumn("_ok", F.lit(1))
    ratio = F.count_if(F.col("_ok").isNull()) / F.nullif(F.count("*"), F.lit(0))
    return expected.select(key).distinct().join(ok, key, "left").agg(F.count("*").alias("expected"), F.count_if(F.col("_ok").isNull()).alias("failed"), ratio.alias("ratio")).withColumn("may_continue", F.coalesce((F.col("ratio") > 0) & (F.col("ratio") <= most), F.lit(False)))


def upper_median(values: Column) -> Column:
    """The middle value of an array, the upper of two."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def probe_summary(calls: DataFrame) -> DataFrame:
    """calls(model, ok, seconds, category) -> per model: calls, success rate, upper median and longest time of good ones."""
    good = F.collect_list(F.when(F.col("ok"), F.col("seconds")))
    return calls.groupBy("model").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("int")).alias("success"), upper_median(good).alias("median"), F.max(F.when(F.col("ok"), F.col("seconds"))).alias("longest"))


def model_scores(models: DataFrame, by_rate: float = 0.6, by_success: float = 0.4) -> DataFrame:
    """models(model, rps, success) by a weighted sum of their rate over the best rate and their success."""
    best = models.agg(F.max("rps").alias("_best"))
    score = by_rate * F.coalesce(F.col("rps") / F.nullif(F.col("_best"), F.lit(0.0)), F.lit(0.0)) + by_success * F.col("success")
    return models.crossJoin(F.broadcast(best)).withColumn("score", score).drop("_best").orderBy(F.desc("score"), "model")


def grouped_sides(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """The values of two tables by key, each side's list empty where it has none."""
    a = left.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("left_values"))
    b = right.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("right_values"))
    none = F.array().cast("array<string>")
    return a.join(b, key, "full").select(key, F.coalesce("left_values", none).alias("left_values"), F.coalesce("right_values", none).alias("right_values"))


def inverted(rows: DataFrame) -> DataFrame:
    """rows(pos, names array, explanation) -> name with its (explanation, pos) in order of pos."""
    each = rows.select(F.explode("names").alias("name"), F.struct("pos", "explanation").alias("use"))
    return each.groupBy("name").agg(F.sort_array(F.collect_list("use")).alias("uses"))


def canonical(rows: DataFrame, synonyms: DataFrame, column: str) -> DataFrame:
    """Distinct rows with the column's values replaced by synonyms(name, canonical), where there is one."""
    s = synonyms.select(F.col("name").alias(column), "canonical").dropDuplicates([column])
    return rows.join(s, column, "left").withColumn(column, F.coalesce("canonical", column)).drop("canonical").distinct()


def unique_titles(nodes: DataFrame, text: str = "content") -> DataFrame:
    """nodes(title, content, ...) with titles that occur twice told apart by the first formula of the text, if any."""
    formula = F.coalesce(F.nullif(F.regexp_extract(text, "(?s)\\$\\$(.+?)\\$\\$", 1), F.lit("")), F.nullif(F.regexp_extract(text, "\\$([^$]+)\\$", 1), F.lit("")))
    twice = F.count("*").over(Window.partitionBy("title")) > 1
    return nodes.withColumn("title", F.when(twice & formula.isNotNull(), F.concat("title", F.lit(" ($"), F.trim(formula), F.lit("$)"))).otherwise(F.col("title")))
