"""Readers and writers: whole documents, JSON nodes and records, strict CSV, graphs, and verified versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMATS = {"md": "markdown", "markdown": "markdown", "tex": "tex"}


def documents(spark: SparkSession, path: str, source_format: str = "auto") -> DataFrame:
    """(doc_id, format, text) of each .md or .tex file below path: a file is a row, its path its id; UTF-8, checked. The
    format follows from the extension unless it's given; any other is an error."""
    if source_format not in ("auto", "markdown", "tex"):
        raise ValueError(f"unknown format {source_format!r}")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,markdown,tex}").load(path)
    ending = F.lower(F.regexp_extract("path", "\\.([A-Za-z]+)$", 1))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), ending) if source_format == "auto" else F.lit(source_format)
    bad = F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))).cast("string")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(bad)
    return rows.select(F.col("path").alias("doc_id"), kind.alias("format"), text.alias("text"))


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, json) of JSON files that hold an object of nodes (its keys) or a list (ordinal keys)."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    wrong = rows.where(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY")).select(F.raise_error(F.lit("nodes must be an object or a list")).cast("string").alias("file"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("json"))
    good = rows.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
    out = good.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return out.select("file", F.coalesce("key", F.col("pos").cast("string")).alias("key"), F.to_json("value").alias("json")).unionByName(wrong)


def records(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """Records of JSON lines, or of JSON documents with a list, without inferring a schema."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def strict_csv(spark: SparkSession, path: str, header: list[str], key: str) -> DataFrame:
    """(line, *header, problem) of a CSV file with exactly this header, in any order: blank lines skipped, physical line
    numbers kept (quoted values stay on one line), the first of equal keys good, later ones `duplicate`; a missing key
    and a wrong number of fields are told too. A wrong header is an error at once."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "^\\x{FEFF}", ""), "\r?\n")).alias("n", "row"))
    first = raw.where("n = 0").first()
    names = [c.strip() for c in (first.row if first else "").split(",")]
    if sorted(names) != sorted(header):
        raise ValueError(f"header {names} instead of {header}")
    body = raw.where((F.col("n") > 0) & (F.trim("row") != ""))
    parsed = F.from_csv("row", ", ".join(f"`{c}` string" for c in names), {"mode": "PERMISSIVE"})
    rows = body.select((F.col("n") + 1).alias("line"), parsed.alias("r"), F.size(F.regexp_extract_all("row", F.lit('(?:^|,)(?:"(?:[^"]|"")*"|[^,]*)'), F.lit(0))).alias("_fields"))
    flat = rows.select("line", *[F.nullif(F.trim(f"r.`{c}`"), F.lit("")).alias(c) for c in header], "_fields")
    nth = F.row_number().over(Window.partitionBy(key).orderBy("line"))
    problem = F.when(F.col("_fields") != len(names), "wrong_fields").when(F.col(key).isNull(), "missing_key").when(nth > 1, "duplicate")
    return flat.withColumn("problem", problem).drop("_fields")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write a graph: nodes as they are, of the edges those with both ends among the nodes."""
    ids = nodes.select("id").distinct()
    good = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    good.select(edges.columns).write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a written graph."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def version_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of every file below a folder: the manifest that commits a version."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def version_problems(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(name, problem) of files that a version's manifest and its folder don't agree on: missing, extra, size or digest."""
    m, f = manifest.toDF("name", "m_size", "m_sha"), found.toDF("name", "f_size", "f_sha")
    both = m.join(f, "name", "full")
    problem = F.when(F.col("f_sha").isNull(), "missing").when(F.col("m_sha").isNull(), "extra").when(F.col("m_size") != F.col("f_size"), "size").when(F.col("m_sha") != F.col("f_sha"), "digest")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def committed_versions(spark: SparkSession, root: str) -> DataFrame:
    """(version) of each folder below root that has a manifest.json."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").load(root)
    return rows.select(F.regexp_extract("path", "([^/]+)/manifest\\.json$", 1).alias("version")).distinct()
