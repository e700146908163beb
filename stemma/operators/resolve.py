"""Resolution of references to earlier statements of the same document, as joins on keys with an order condition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_index(nodes: DataFrame) -> DataFrame:
    """nodes(doc_id, pos, type, number, aliases array, tex_label, title) -> (doc_id, tier, key, pos): TeX labels first, then
    type and number, then aliases; titles of four characters or more last."""
    tex = nodes.where("tex_label is not null").select("doc_id", F.lit(1).alias("tier"), F.col("tex_label").alias("key"), "pos")
    numbered = nodes.where("type is not null and number is not null").select("doc_id", F.lit(2).alias("tier"), F.concat_ws("\0", "type", "number").alias("key"), "pos")
    alias = nodes.select("doc_id", F.lit(3).alias("tier"), F.explode(F.array_distinct("aliases")).alias("key"), "pos")
    title = nodes.where(F.length(F.trim("title")) >= 4).select("doc_id", F.lit(4).alias("tier"), F.trim("title").alias("key"), "pos")
    return tex.unionByName(numbered).unionByName(alias).unionByName(title)


def resolved(hits: DataFrame, index: DataFrame) -> DataFrame:
    """hits(doc_id, pos, hit, kind, type, number, surface) -> each with target: the nearest earlier statement of the first
    tier that has one. Unresolved hits tell why: only_forward_candidate, duplicate_label_or_alias or no_candidate."""
    key = F.when(F.col("kind") == "tex", F.array(F.struct(F.lit(1).alias("tier"), F.col("number").alias("key"))))
    key = key.otherwise(F.array(F.struct(F.lit(2).alias("tier"), F.concat_ws("\0", "type", "number").alias("key")), F.struct(F.lit(3).alias("tier"), F.regexp_replace("surface", "\\s+", "").alias("key"))))
    asked = hits.select("doc_id", "pos", "hit", F.explode(key).alias("k")).select("doc_id", "pos", "hit", "k.tier", "k.key")
    found = asked.join(index.withColumnRenamed("pos", "at"), ["doc_id", "tier", "key"])
    per = found.groupBy("doc_id", "pos", "hit").agg(
        F.min(F.when(F.col("at") < F.col("pos"), F.struct("tier", -F.col("at")))).alias("best"),
        F.count_distinct("at").alias("n"), F.count_if(F.col("at") > F.col("pos")).alias("ahead"),
    )
    out = hits.join(per, ["doc_id", "pos", "hit"], "left")
    target = -F.col("best")["col2"]
    why = F.when(F.col("best").isNotNull(), None).when(F.col("n").isNull(), "no_candidate").when((F.col("n") == 1) & (F.col("ahead") >= 1), "only_forward_candidate").otherwise("duplicate_label_or_alias")
    return out.select(*hits.columns, target.alias("target"), why.alias("reason"))


def forward_repairs(unresolved: DataFrame, index: DataFrame) -> DataFrame:
    """Unresolved hits whose type and number name exactly one statement, which lies ahead: that one, as `target`."""
    only = index.where("tier = 2").groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.min("pos").alias("at")).where("n = 1")
    asked = unresolved.drop("target", "reason").withColumn("key", F.concat_ws("\0", "type", "number"))
    return asked.join(only, ["doc_id", "key"]).where(F.col("at") > F.col("pos")).withColumnRenamed("at", "target").drop("key", "n")


def explicit_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """links(doc_id, pos, target), nodes(doc_id, pos, type) -> distinct (doc_id, dependent, support, relation) without
    self-references; the relation follows from the support's type."""
    kind = nodes.select("doc_id", F.col("pos").alias("target"), "type")
    relation = F.when(F.lower("type").isin("定义", "公理", "definition", "axiom"), "definition").otherwise("logic")
    rows = links.where("target is not null and target <> pos").select("doc_id", "pos", "target").join(kind, ["doc_id", "target"])
    return rows.select("doc_id", F.col("pos").alias("dependent"), F.col("target").alias("support"), relation.alias("relation")).distinct()


def reference_quality(links: DataFrame) -> DataFrame:
    """Resolved hits (doc_id, target, reason) -> per document the hits, those unresolved, and those by reason."""
    per = {"no_candidate": "no_candidate", "only_forward": "only_forward_candidate", "ambiguous": "duplicate_label_or_alias"}
    counts = [F.count_if(F.col("reason") == why).alias(name) for name, why in per.items()]
    return links.groupBy("doc_id").agg(F.count_if(F.col("target").isNull()).alias("unresolved"), *counts, F.count("*").alias("hits"))


def candidate_places(nodes: DataFrame) -> DataFrame:
    """nodes(doc_id, pos, type, number, aliases) -> (doc_id, key, candidates): every place of each type with number and of
    each alias, in order; a statement that has an alias twice is listed twice, so that such an alias isn't unique."""
    numbered = nodes.where("type is not null and number is not null").select("doc_id", F.concat_ws("\0", "type", "number").alias("key"), "pos")
    return numbered.unionByName(nodes.select("doc_id", F.explode("aliases").alias("key"), "pos")).groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("pos")).alias("candidates"))
