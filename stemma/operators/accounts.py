"""Tables of users, sessions, settings and queues: guarded lookups, idempotent inserts, upserts, state repair, import checks;
and the acceptance of corrected batches with its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def owned(rows: DataFrame, key: str, value, owner: str) -> DataFrame:
    """The undeleted row of a key if it is the owner's: one row at most."""
    return rows.where((F.col(key) == F.lit(value)) & (F.col("owner") == owner) & F.col("deleted_at").isNull()).limit(1)


def enqueued(queue: DataFrame, rows: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """queue with those rows whose key it doesn't hold; of rows with one key the least is added. Rows without a key go."""
    new = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("_r")).select(key, "_r.*")
    return queue.unionByName(new.join(queue.select(key).distinct(), key, "left_anti").select(queue.columns))


def import_conflicts(records: DataFrame, users: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(row, field, value) of records(row, fields) whose value a user has already, case and blanks at the ends aside."""
    folded = lambda c: F.lower(F.trim(F.col(c)))
    out = None
    for f in fields:
        taken = users.select(folded(f).alias("_v")).where("_v <> ''").distinct()
        hit = records.withColumn("_v", folded(f)).join(taken, "_v", "left_semi").select("row", F.lit(f).alias("field"), F.col(f).alias("value"))
        out = hit if out is None else out.unionByName(hit)
    return out


def upserted(rows: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with new ones added or replacing those of the same keys; of several new ones the last by `order`."""
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), order).alias("_r")).select("_r.*").select(rows.columns)
    return rows.join(last, keys, "left_anti").select(rows.columns).unionByName(last)


def repaired_states(rows: DataFrame, now: Column) -> DataFrame:
    """rows(status, created_at, updated_at) after a restart: running ones are paused, and a missing updated_at takes
    created_at, or now without one."""
    return rows.withColumns({"status": F.when(F.col("status") == "running", "paused").otherwise(F.col("status")), "updated_at": F.coalesce("updated_at", "created_at", now)})


def accepted_corrections(units: DataFrame, answers: DataFrame) -> DataFrame:
    """units(doc_id, batch, pos, unit, text), answers(doc_id, batch, ids array, texts array) -> units with `final` and `state`.

    A batch's answer counts when it has exactly the batch's units in order, as many texts, and none of them blank; else
    every unit of the batch falls back to its source. state: changed, same or fallback.
    """
    asked = units.groupBy("doc_id", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "unit"))), lambda x: x["unit"]).alias("asked"))
    ok = (F.col("ids") == F.col("asked")) & (F.size("texts") == F.size("ids")) & F.forall("texts", lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")
    good = asked.join(answers.dropDuplicates(["doc_id", "batch"]), ["doc_id", "batch"]).where(ok).select("doc_id", "batch", F.map_from_arrays("ids", "texts").alias("_m"))
    out = units.join(good, ["doc_id", "batch"], "left").withColumn("_t", F.try_element_at("_m", F.col("unit")))
    state = F.when(F.col("_m").isNull(), "fallback").when(F.col("_t") != F.col("text"), "changed").otherwise("same")
    return out.withColumns({"final": F.coalesce("_t", "text"), "state": state}).drop("_m", "_t")


def correction_report(corrected: DataFrame, most: float = 0.3) -> DataFrame:
    """One row per document: units, changed and fallen back ones, the share of the latter, and whether it is low enough."""
    per = corrected.groupBy("doc_id").agg(F.count("*").alias("units"), F.count_if(F.col("state") == "changed").alias("changed"), F.count_if(F.col("state") == "fallback").alias("fallback"))
    return per.withColumn("ratio", F.col("fallback") / F.col("units")).withColumn("passed", F.col("ratio") <= most)


def completed(results: DataFrame, expected: DataFrame, threshold: float = 0.9) -> DataFrame:
    """expected(key), results(key, round, ok) -> one row per round: keys done up to it, their share, whether another round is
    needed (the share is under the threshold)."""
    first = results.where("ok").join(expected.distinct(), "key", "left_semi").groupBy("key").agg(F.min("round").alias("at"))
    rounds = results.select("round").distinct()
    n = expected.select("key").distinct().agg(F.count("*").alias("expected"))
    done = rounds.join(first, F.col("at") <= F.col("round"), "left").groupBy("round").agg(F.count("key").alias("done"))
    return done.crossJoin(F.broadcast(n)).withColumn("share", F.col("done") / F.col("expected")).withColumn("again", F.col("share") < threshold)
