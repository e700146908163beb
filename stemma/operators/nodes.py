"""Statement nodes: accessors over their fields, sealing, guarded merges, match units, and verdict guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.text import content_id, nfc
from stemma.functions.types import is_relation


def _filled(*columns: Column) -> Column:
    """The first column that isn't null or blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def content(node_text: str = "content") -> Column:
    """A node's text: disambiguated, else its remark's original, else its content."""
    return _filled(F.col("disambiguated"), F.col("remark.original_form"), F.col(node_text))


def field_texts(items: Column) -> Column:
    """The distinct texts of an array of (text, text_normalized), the normal form where there is one, in order."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: _filled(x["text_normalized"], x["text"])), lambda t: t.isNotNull()))


def statement(conditions: Column, conclusions: Column) -> Column:
    """Conditions, then conclusions, each list joined with "; "."""
    c, d = F.array_join(field_texts(conditions), "; "), F.array_join(field_texts(conclusions), "; ")
    return F.when(c == "", d).when(d == "", c).otherwise(F.concat(c, F.lit("; "), d))


def sealed(nodes: DataFrame) -> DataFrame:
    """nodes(node_type, source_original_form, content, ...) with global_id (MD5 of the authoritative text: the source form
    alone for relations) and source_sha256."""
    source = F.when(is_relation(F.col("node_type")), F.col("source_original_form")).otherwise(_filled(F.col("source_original_form"), F.col("content")))
    return nodes.withColumns({"global_id": content_id(source), "source_sha256": F.sha2(F.coalesce(nfc(source), F.lit("")), 256)})


def merged_under_seal(nodes: DataFrame, derived: DataFrame, allowed: list[str]) -> DataFrame:
    """nodes(global_id, source_sha256, ...) with the allowed columns of derived(global_id, source_sha256, ...) where it has
    them; other derived columns are listed in `ignored`. A digest that differs is an error."""
    ignored = [c for c in derived.columns if c not in (*allowed, "global_id", "source_sha256")]
    d = derived.select("global_id", F.col("source_sha256").alias("_sha"), *[F.col(c).alias(f"_{c}") for c in allowed], F.array(*[F.lit(c) for c in ignored]).cast("array<string>").alias("ignored"))
    joined = nodes.join(d, "global_id", "left")
    wrong = F.raise_error(F.concat(F.lit("source changed: "), F.col("global_id"))).cast("string")
    sha = F.when(F.col("_sha").isNull() | (F.col("_sha") == F.col("source_sha256")), F.col("source_sha256")).otherwise(wrong)
    kept = [F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in allowed else F.col(c) for c in nodes.columns if c != "source_sha256"]
    new = [F.col(f"_{c}").alias(c) for c in allowed if c not in nodes.columns]
    return joined.select(*kept, *new, sha.alias("source_sha256"), "ignored")


def match_units(nodes: DataFrame) -> DataFrame:
    """nodes(doc_id, pos, global_id, content, degraded, sub_nodes array<struct<index,content,conclusion>>) -> (doc_id, pos,
    parent, unit, text): a row per sub-node, or one for the node itself; degraded nodes have none."""
    good = nodes.where(~F.coalesce(F.col("degraded"), F.lit(False)))
    rows = good.select("doc_id", "pos", F.col("global_id").alias("parent"), "content", F.explode_outer("sub_nodes").alias("s"))
    unit = F.when(F.col("s").isNull(), F.col("parent")).otherwise(F.concat(F.col("parent"), F.lit("__sub"), F.col("s.index").cast("string")))
    return rows.select("doc_id", "pos", "parent", unit.alias("unit"), F.coalesce("s.content", "content").alias("text"))


def iff_directions(conclusion: Column) -> Column:
    """array of (source, target): both directions of a two-part equivalence, the cycle of a longer one; empty otherwise."""
    parts = F.filter(F.transform(F.split(F.coalesce(conclusion, F.lit("")), "(?i)\\s*(?:\\\\iff|\\\\Leftrightarrow|⇔|\\bif and only if\\b|\\biff\\b|当且仅当)\\s*"), F.trim), lambda p: p != "")
    n = F.size(parts)
    pair = lambda i: F.struct(F.get(parts, i.cast("int")).alias("source"), F.get(parts, ((i + 1) % n).cast("int")).alias("target"))
    return F.when(n < 2, F.array().cast("array<struct<source:string,target:string>>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), pair))


def deduplicated(nodes: DataFrame) -> DataFrame:
    """The first node (by pos) of each global_id with the number of copies; two sources under one id are an error."""
    w = Window.partitionBy("global_id")
    marked = nodes.withColumns({"_n": F.row_number().over(w.orderBy("pos")), "copies": F.count("*").over(w), "_lo": F.min("source_sha256").over(w), "_hi": F.max("source_sha256").over(w)})
    clash = F.raise_error(F.concat(F.lit("one id, two sources: "), F.col("global_id"))).cast("string")
    checked = marked.withColumn("global_id", F.when(F.col("_lo").eqNullSafe(F.col("_hi")), F.col("global_id")).otherwise(clash))
    return checked.where("_n = 1").drop("_n", "_lo", "_hi")


def judged_verdicts(verdicts: DataFrame) -> DataFrame:
    """verdicts(key, verdict, level, evidence array, missing_premise, excluded) with `verdict` guarded and guard_reason: an
    accepted one needs evidence, an explicit or direct level, no missing premise and no exclusion; one for review an
    indirect level; all else is rejected."""
    reason = (
        F.when(~F.coalesce(F.col("verdict").isin("accepted", "review", "rejected"), F.lit(False)), "unknown_verdict")
        .when(F.col("verdict") == "rejected", F.lit(None))
        .when(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "no_evidence")
        .when((F.col("verdict") == "accepted") & ~F.coalesce(F.col("level").isin("explicit", "direct"), F.lit(False)), "level_too_weak")
        .when((F.col("verdict") == "review") & ~F.coalesce(F.col("level") == "indirect", F.lit(False)), "level_not_indirect")
        .when(F.coalesce(F.col("missing_premise"), F.lit(False)), "missing_premise")
        .when(F.coalesce(F.col("excluded"), F.lit(False)), "excluded")
    )
    return verdicts.withColumn("guard_reason", reason).withColumn("verdict", F.when(F.col("guard_reason").isNotNull(), "rejected").otherwise(F.col("verdict")))


def cleaning_decisions(nodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """nodes(key, text), decisions(key, action) -> nodes with action: missing or unknown ones are reviewed by hand, and so
    is what would be quarantined although it shows mathematics."""
    joined = nodes.join(decisions.select("key", F.col("action").alias("_a")), "key", "left")
    math = F.coalesce(F.col("text"), F.lit("")).rlike("[$=<>∀∃∈≤≥→⇒]|\\\\[A-Za-z]+|\\d\\s*[+*/^-]\\s*\\d")
    action = F.when(F.col("_a").isin("keep", "clean", "quarantine"), F.when((F.col("_a") == "quarantine") & math, "manual_review").otherwise(F.col("_a"))).otherwise("manual_review")
    return joined.withColumn("action", action).drop("_a")
